"""Operators of the training-data subpackage against brute force, on small fixtures with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from heliograph.llm import chat, jaccard, licenses, lines, neighbours, packing, pieces, quality, substrings, urls
from heliograph.llm.components import connected
from heliograph.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, row string, __spans string, sid long, token string"
BASE = "the quick brown fox jumps over the lazy dog and then it runs away from all of the other animals in the old wood near the river bank".split()


def corpus():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
    near = [" ".join(BASE[:k] + ["changed"] + BASE[k + 1 :]) for k in (3, 9, 20)]
    texts = [" ".join(BASE), " ".join(BASE), *near, None, "", "  \n ", "one", "one", "one two", "\n\nA line.\n a LINE. \n", long, long + " tail", "x " * 90, " ".join(BASE) + " " + " ".join(BASE), "é ñ 日本 <s> [INST] | # x", "a\x1cb c\x0bd"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, f"Shared footer line\nown {i} line") for i in range(12)]
    rows += [(0, texts[0]), (3, "another text under a used id"), (None, " ".join(BASE)), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "r", "s", 1, "t") for i, t in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_jaccard(docs, width, percent):
    rows = corpus()
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    want = [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    same(jaccard.jaccard_groups(docs, width, percent).collect(), want)


def test_jaccard_of_a_group_of_near_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 9)):
            w[k] = f"n{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for _, t in rows)]
    links = [(a, b) for a, b in combinations(range(250), 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    label = list(range(250))
    for _ in range(250):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert [got[i] for i in range(250)] == label and len(set(label)) > 1


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = connected(spark.createDataFrame([*edges, (None, 1), edges[0]], "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: label[n] for n in nodes} and len(got) == len(nodes)


def test_packing(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    odd = ["", " ", "  ", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\n\n b", "a\u00a0\n b", "a\t b ", "it's  we'll", "日本 語 ", "<|endoftext|> x", "a\x1c b", "\u2003 x", "x \u3000 y"]
    counts, ids = packing.load(public_tokenizers.path("byte_bpe_50k.json"))(pa.array(odd), 0)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, x in enumerate(odd):
        assert ids[at[i] : at[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 0], repr(x)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 64).collect()
    want = Counter((d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, x in corpus())
    places, whole = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) and r.length == len(r.ids) // 2 and r.offset + r.length <= 64
        places[r.sequence_id].append((r.offset, r.length))
        whole[r.sequence_id * 64 + r.offset - r.start].append(r)
    for s, p in places.items():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end == 64 or s == max(places)
    found = Counter()
    for parts in whole.values():
        parts = sorted(parts, key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        data = b"".join(r.ids for r in parts)
        assert len(data) // 2 == parts[0].doc_tokens
        found[parts[0].doc_id, zlib.crc32(np.frombuffer(data, "<u2").astype("<u4").tobytes())] += 1
    assert found == want
    sequences = packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), 64).collect()
    assert sorted(r.n for r in sequences)[1:] == [64] * (len(sequences) - 1) and sum(r.n for r in sequences) == sum(r.length for r in got)


def _kept_lines(rows, least):
    strip = lambda x: low(x.strip(" \t\n\v\f\r"))
    n = Counter(k for _, t in rows for k in {strip(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if n[strip(x)] < least]
        out.append((d, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


@pytest.mark.parametrize("bound", [lines.BROADCAST_KEYS, -1])
@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(docs, least, bound):
    same(lines.dedup_lines(docs, least=least, bound=bound, report=True).collect(), _kept_lines(corpus(), least))
    full = lines.dedup_lines(docs, least=least, bound=bound)
    assert full.columns == docs.columns and full.count() == docs.count()


def _state(index):
    counts = sorted(map(tuple, index.counts.collect()))
    shards = {r.shard: (bytes(r.filter), bytes(r["keys"])) for r in index.shards.collect()}
    keys = {s: {tuple(k) for k in np.frombuffer(x, np.int64).reshape(-1, 2).tolist()} for s, (_, x) in shards.items()}
    for s, (table, x) in shards.items():
        own = np.frombuffer(x, np.int64).reshape(-1, 2)
        assert lines.CuckooFilter.read(table).contains(own[:, 0].copy().view(np.uint64)).all()
        assert np.count_nonzero(np.frombuffer(table, np.uint16)) == len(own)
    return counts, keys


def test_line_index_is_reversible(spark, docs, none, tmp_path):
    first, second = docs.where("doc_id < 105"), docs.where("doc_id >= 105 or doc_id is null")
    once = lines.LineIndex.empty(spark, 3, 4).insert(first)
    both = once.insert(second)
    assert _state(both) == _state(lines.LineIndex.empty(spark, 3, 4).insert(docs)) and _state(both) != _state(once)
    assert {k for own in _state(both)[1].values() for k in own} == {(a, b) for a, b, n in _state(both)[0] if n >= 3}
    assert _state(both.delete(second)) == _state(once) and _state(both.delete(docs)) == ([], {})
    assert _state(both.delete(second).insert(second).insert(none).delete(none)) == _state(both)
    both.write(str(tmp_path / "index"))
    index = lines.LineIndex.read(spark, str(tmp_path / "index"), 3, 4)
    for bound in (lines.BROADCAST_KEYS, -1):
        same(lines.dedup_lines(first, index, bound=bound, report=True).collect(), [r for r in _kept_lines(corpus(), 3) if r[0] is not None and r[0] < 105])


def test_cuckoo_filter():
    h = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    f = lines.CuckooFilter.of(h)
    assert f.contains(h).all() and lines.CuckooFilter.read(f.tobytes()).contains(h).all()
    assert all(f.delete(int(x)) for x in h) and not f.table.any()


@pytest.mark.parametrize("k", [8, 20])
def test_substring_dedup(docs, k):
    rows = corpus()
    seen = defaultdict(list)
    for d, t in rows:
        w = WORD.findall(t or "")
        h = sha(t or "") if (d, t) != (None, None) else ""
        for i in range(len(w) - k + 1):
            seen[tuple(w[i : i + k])].append(((d is None, d or 0), h, i))
    want = Counter()
    unsure = {3}  # two texts under one id are ordered by a hash
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - k + 1):
            me = ((d is None, d or 0), i)
            if any((x, j) < me for x, _, j in seen[tuple(w[i : i + k])]):
                gone |= set(range(i, i + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[d, len(w), len(gone), sha(" ".join(kept))] += 1
    got = Counter(tuple(r) for r in substrings.dedup_substrings(docs, k, report=True).collect())
    assert {x: n for x, n in got.items() if x[0] not in unsure} == {x: n for x, n in want.items() if x[0] not in unsure}
    full = substrings.dedup_substrings(docs, k)
    assert full.columns == docs.columns and full.count() == docs.count()


def test_quality(docs):
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars, r.n_symbols, r.base_failed) for r in quality.quality_report(docs).collect()}
    want = set()
    for d, t in corpus():
        w = WORD.findall(t or "")
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.add((d, len(w), len(rep), len(ls) - len(set(ls)), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    assert got == want
    kept = quality.quality_report(docs).where("kept").count()
    assert quality.quality_filter(docs).count() == kept and quality.quality_filter(docs).columns == docs.columns


def test_urls(spark):
    cases = ["http://Example.ORG/es/x?y", "https://a.example.org/en/1#t", "http://notexample.org/es/", "http://x.com", "http://x.com/fr/a", "http://com/de/", None, "", "no host", "http://a.b.com:80/de/z", "ftp://org?x/", "x://y://z.org/", "http://org/\nes"]
    pages = spark.createDataFrame([(i % 11, u, "x") for i, u in enumerate(cases * 3)], "page_id long, url string, key string")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]
    want = []
    for i, u in enumerate(cases * 3):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i % 11, host, path, *(max(fit)[2:] if fit else (None, "allow"))))
    same(urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect(), want)


def test_templates():
    a = licenses.compile_template("copyright <<optional>> c <<end>> <<any 3>> all rights reserved", "x")
    for text, n in (("copyright all rights reserved", 4), ("copyright c 2020 acme all rights reserved now", 7), ("copyright a b c d all rights reserved", 0), ("copyright c c all rights", 0)):
        assert a.longest(text.split()) == n
    with pytest.raises(ValueError):
        licenses.compile_template("<<any 2>> x", "x")


def _said(markup, rng):
    """A text that a template accepts, with optional and replaceable regions drawn at random."""
    out, skip = [], 0
    for x in licenses.items_of(markup):
        if x == "<<optional>>":
            skip += 1 if skip or rng.random() < 0.5 else 0
            out.append(None) if not skip else None
        elif x == "<<end>>":
            skip = max(0, skip - 1)
        elif skip:
            continue
        elif x.startswith("<<any"):
            out += [f"name{i}" for i in range(int(rng.integers(0, int(x[6:-2]) + 1)))]
        else:
            out.append(x)
    return [x for x in out if x]


def _pattern(markup):
    marks = {"<<optional>>": "(?:", "<<end>>": ")?"}
    return "".join(marks.get(x) or (f"(?:[^ ]+ ){{0,{x[6:-2]}}}" if x.startswith("<<any") else regex.escape(x) + " ") for x in licenses.items_of(markup))


def test_licenses(spark):
    rng = np.random.default_rng(8)
    texts = ["Released under the MIT License. mit-license!", "GNU General Public License, version 3 and the Apache License, Version 2.0", "licensed under CC BY-NC 4.0", "mit\nlicense", "mitlicense ümit license", None, "", "MIT", "mit license " * 3,
             "copyright c a all rights reserved b all rights reserved c", "x " * 3000 + "copyright all rights reserved"]
    for markup, _ in licenses.TEMPLATES:
        for _ in range(4):
            w = _said(markup, rng)
            texts += [" ".join(["before", *w, "after"]), " ".join(w).upper().replace(" ", ", \n"), " ".join([*w[:-2], "instead", *w[-1:]])]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, TEXT string, labels string")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    compiled = [(regex.compile("(?p)" + _pattern(m)), label, base) for base, group in ((True, licenses.PHRASES), (False, licenses.TEMPLATES)) for m, label in group]
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        at = [(j, label) for p, label in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        line, begin = "".join(x + " " for x in w), np.cumsum([0, *(len(x) + 1 for x in w)])
        labels, cover = set(), set()
        for j in range(len(w)):
            for pattern, label, _ in compiled:
                m = pattern.match(line, int(begin[j]))
                if m and m[0]:
                    labels.add(label)
                    cover |= set(range(j, j + m[0].count(" ")))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0])
        assert (r.base_labels, r.labels) == (",".join(sorted({x for _, x in at})), ",".join(sorted(labels))), t
        assert r.score == len(cover) / max(1, len(w))
    assert got[1].labels == "apache,apache-2.0,gpl,gpl-3.0" and got[2].labels == "cc-by-nc" and got[9].score == 10 / 11


def test_whole_licenses(spark):
    rng = np.random.default_rng(9)
    rows, want = [(0, None), (1, ""), (2, "MIT License"), (3, "copyright")], {0: None, 1: None, 2: None, 3: None}
    for markup, label in licenses.TEXTS:
        for head in ("", "The MIT License (MIT)\n\nCopyright (c) 2020-2024 Some One <some@one.example>\n\n", "Copyright 1999 X. All rights reserved. "):
            w = " ".join(_said(markup, rng))
            for text, said in ((head + w, label), (head + w + " more", None), (head + w.replace("software", "hardware", 1), None)):
                want[len(rows)] = said
                rows.append((len(rows), text))
    got = {r.doc_id: r.license for r in licenses.identify_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def _exact(ids, m, k):
    """The k nearest of each vector whose id is divisible by 50, by brute force: lists of ids."""
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        s[ids == ids[i]] = -2
        out[int(ids[i])] = [int(x) for x in ids[np.lexsort((ids, -np.round(s, 12)))[:k]]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32))
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x.astype(np.float32))]
    rows += [(5000 + i, rows[0][1], 0) for i in range(40)] + [(6000, None, 0), (6001, [0.0] * 32, 0), (6002, [float("nan")] * 32, 0), (6003, [None] * 32, 0), (None, rows[1][1], 0), (6005, [], 0), (0, rows[0][1], 0)]
    rows += [(7000, [1.0], 0), (7001, [2.0], 0), (7050, [-1.0], 0), (8000, [1.0, 2.0, 3.0], 0), (2999, rows[2999][1], 0), (2999, rows[2999][1], 0)]
    v = spark.createDataFrame(rows, "vec_id long, v array<float>, score int")
    got, chosen = defaultdict(list), []
    for r in neighbours.nearest(v, v.where("vec_id % 50 = 0"), 5, chosen).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    full = [(i, y) for i, y, _ in rows if i is not None and y and len(y) == 32 and all(z is not None and z == z for z in y) and any(y)]
    want = _exact(np.array([i for i, _ in full]), np.array([y for _, y in full], float), 5)
    hit = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert hit / (5 * len(want)) >= 0.9 and set(got) == set(want) | {7000, 7050} and got[0] == [5000, 5001, 5002, 5003, 5004]
    assert got[7050] == [7000, 7001] and got[7000] == [7001, 7050] and len(chosen) == 1 and chosen[0].recall >= 0.92
    few = neighbours.nearest(v.where("vec_id < 3"), v.where("vec_id = 0").limit(1)).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_neighbours_of_the_table(spark):
    v = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    chosen: list = []
    got = defaultdict(list)
    for r in neighbours.nearest(v, v.where("vec_id % 50 = 0"), 5, chosen).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    t = v.toPandas()
    ids, m = t.vec_id.to_numpy(), np.array(t.v.tolist(), float)
    want = _exact(ids, m, 5)
    recall = sum(len(set(want[q]) & {i for i, _ in got[q]}) for q in want) / (5 * len(want))
    (codes,) = chosen
    x = m / np.linalg.norm(m, axis=1, keepdims=True)
    own, asked = codes.of(x), np.flatnonzero(ids % 50 == 0)[:50]
    share = np.mean([(np.bitwise_count(own ^ own[q]) <= codes.reach).any(axis=1).mean() for q in asked])
    assert recall >= 0.9 and share <= 0.15, (recall, share)
    place = {i: j for j, i in enumerate(ids)}
    assert all(abs(s - x[place[q]] @ x[place[i]]) < 1e-12 for q, rows in got.items() for i, s in rows)


def test_every_code_within_the_radius_is_probed():
    rng = np.random.default_rng(2)
    codes = neighbours.Codes(rng.standard_normal((8, 64)), 4, 1, 1.0, 0.0)
    values = rng.integers(0, 1 << 16, (200, 4)).astype(np.uint16)
    for base in values[:20]:
        probes = base[:, None] ^ codes.masks()
        for _ in range(50):
            flips = rng.permutation(64)[: 4 * (codes.reach + 1) - 1]
            near = base.copy()
            for f in flips:
                near[f // 16] ^= np.uint16(1 << (f % 16))
            assert any(near[s] in probes[s] for s in range(4))


def test_pieces(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(0)
    odd = ["", " ", " a", "a  b ", "▁", "a▁b", "aaaaaaa", "日本 😀\n", "<s> <0x41>", *("".join(rng.choice(list("ab▁ é\n日the."), rng.integers(0, 30))) for _ in range(500))]
    model = pieces.load(path)
    counts, ids = model.encode(pa.array(odd))
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(odd):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == sp.encode(t) and model.decode(own) == sp.decode(own.tolist())
    encoded = pieces.encode_pieces(docs, path)
    same([(r.doc_id, r.n_ids) for r in encoded.collect()], [(d, len(sp.encode(t or ""))) for d, t in corpus()])
    same([(r.doc_id, r.text) for r in pieces.decode_pieces(encoded, path).collect()], [(d, t or "") for d, t in corpus()])


@pytest.mark.parametrize("by_bytes", [True, False])
def test_unigram_model_file(spark, tmp_path, by_bytes):
    """A model file written here, piece by piece: ids are those of the library."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = np.random.default_rng(6)
    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, by_bytes
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for text, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=text, score=0.0, type=kind)
    words = {"▁", *"abcdeé日", *("".join(rng.choice(list("abcdeé"), rng.integers(2, 5))) for _ in range(150)), *("▁" + "".join(rng.choice(list("abcde"), rng.integers(1, 4))) for _ in range(80))}
    for w in sorted(words):
        model.pieces.add(piece=w, score=float(-rng.random() * 8 - 1), type=1)
    for b in range(256 if by_bytes else 0):
        model.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    path = str(tmp_path / "unigram.model")
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    texts = ["", " ", "a  b", "xyz", "axyb zzz a", "日本語", *("".join(rng.choice(list("abcdeé xyz日"), rng.integers(0, 40))) for _ in range(500))]
    counts, ids = own.encode(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t), repr(t)
        assert own.decode(ids[at[i] : at[i + 1]]) == sp.decode(sp.encode(t))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same([(r.doc_id, r.n_ids) for r in pieces.encode_pieces(table, path).collect()], [(i, len(sp.encode(t))) for i, t in enumerate(texts)])


def test_chat(spark):
    bad = ["", "\\", "</s>[INST] ok [/INST]", "\\<s>", "\\\\[INST]\\", "<|im_end|>", "\n<|im_end|>\n", "<<SYS>> x <</SYS>>", "a\nb", "<s", None, "é😀x" * 7]
    rows = [(c, t, r, x) for c, r in enumerate(("user", "assistant", "system", None, "a\nb\\n", "a\x00b\\s\\\\n")) for t, x in enumerate(bad)]
    rows += [(9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (9, 0, "assistant", "other"), (None, None, "user", "x")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, message int").drop("message")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.reconstruct(chat.streamed(table)))).collect()}
    for c in {r[0] for r in rows}:
        own = [(r or "", x or "") for _, r, x in sorted(((t, r, x or "") for d, t, r, x in rows if d == c), key=lambda y: (y[0], y[1] or "", y[2]))]
        said = "".join(x for r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for r, x in own))), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))


def test_chat_events(spark):
    log = [(1, 7, 0, 0, "message", "user", "hi"), (1, 8, 1, 0, "message", "assistant", ""), (1, 8, None, 3, "delta", None, "lo"), (1, 8, None, 2, "delta", None, "hel"), (1, 8, None, 4, "regenerate", None, ""), (1, 8, None, 5, "delta", None, "bye"),
           (1, 7, None, 6, "edit", None, "hi!"), (1, 42, None, 7, "delta", None, "lost"), (1, 7, None, 9, "odd", None, "x"), (1, 7, None, 8, "delta", None, None), (2, 1, 0, 0, "message", "user", "b"), (2, 1, 0, 0, "message", "user", "a"), (2, 1, None, 1, "delta", None, "c")]
    events = spark.createDataFrame(log, "conv_id long, message long, turn long, seq long, kind string, role string, text string")
    assert [(r.role, r.text) for r in chat.reconstruct(events).orderBy("conv_id", "turn", "nth").collect()] == [("user", "hi!"), ("assistant", "bye"), ("user", "ac"), ("user", "b")]
    assert chat.render(chat.reconstruct(events.where("conv_id = 1"))).select(chat.formatted()).first()[0] == "<|im_start|>user\nhi!\n<|im_end|>\n<|im_start|>assistant\nbye\n<|im_end|>\n"


def test_chat_folds_like_a_loop(spark):
    rng = np.random.default_rng(4)
    log, want = [], {}
    for m in range(60):
        text = ""
        for seq in range(int(rng.integers(1, 12))):
            kind = "message" if not seq else str(rng.choice(["delta", "delta", "edit", "regenerate"]))
            x = "".join(rng.choice(list("ab"), 3))
            text = text + x if kind == "delta" else x
            log.append((0, m, m if not seq else None, seq, kind, "assistant" if not seq else None, x))
        want[m] = text
    rng.shuffle(log)
    events = spark.createDataFrame([tuple(None if x is None else x if isinstance(x, str) else int(x) for x in r) for r in log], "conv_id long, message long, turn long, seq long, kind string, role string, text string")
    assert {r.turn: r.text for r in chat.reconstruct(events).collect()} == want


def test_empty_tables(spark, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (
        jaccard.jaccard_groups(none), packing.pack(none, path), packing.sequences(none, path), lines.dedup_lines(none), lines.dedup_lines(none, bound=-1), lines.dedup_lines(none, report=True), substrings.dedup_substrings(none),
        quality.quality_report(none), quality.quality_filter(none), licenses.scan_licenses(none), pieces.encode_pieces(none, public_tokenizers.path("piece_bpe_32k.model")),
        urls.judge_urls(none.selectExpr("doc_id as page_id", "text as url"), spark.createDataFrame([], "host string, path string, verdict string")),
        neighbours.nearest(*[none.selectExpr("doc_id as vec_id", "cast(null as array<float>) as v")] * 2),
        chat.read_back(chat.render(chat.reconstruct(chat.streamed(none.selectExpr("doc_id as conv_id", "doc_id as turn", "lang as role", "text"))))),
    ):
        assert df.isEmpty()


def _normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda x: "null" if x is None or x is pd.NA or x != x else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)  # noqa: E731  a nullable long may come as a float
    return sorted(map(tuple, frame.map(cell).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert _normal(QUERIES[name](spark, SF).toPandas()) == _normal(con.execute(ORACLES[name]).df())


def _passes(text):
    w = WORD.findall(text or "")
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    m = {"n_words": len(w), "n_repeat_words": len(rep), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_stop": sum(x in quality.STOP_WORDS for x in w),
         "n_dup_lines": len(ls) - len(set(ls)), "n_lines": len(ls), "n_bullets": sum(x.lstrip(" ")[:1] in tuple("-*•‣") for x in ls)}
    for rule in quality.BASE + quality.PROSE:
        top, _, low_ = rule.value.partition(" / ")
        value = m[top.removeprefix("100 * ")] * (100 if top.startswith("100") else 1)
        if low_ and not m[low_]:
            continue
        if not rule.low <= (value / m[low_] if low_ else value) <= rule.high:
            return False
    return True


def _one_of_each(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    label = list(range(len(rows)))
    for _ in rows:
        before = list(label)
        for a, b in combinations(range(len(rows)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[label[i]].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def _without_repeats(rows, k):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            me = (d is None, d or 0, i)
            first[tuple(w[i : i + k])] = min(first.get(tuple(w[i : i + k]), me), me)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {i + j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < (d is None, d or 0, i) for j in range(k)}
        out.append((d, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


def _pipeline_rows():
    rng = np.random.default_rng(12)
    stop = [x for x in quality.STOP_WORDS if x.isascii()]
    vocabulary = stop[:20] * 30 + ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9))) for _ in range(1500)]

    def prose(n):
        return [str(x) for x in rng.choice(vocabulary, n)]

    base, shared = prose(120), " ".join(prose(70))
    rows = [(i, " ".join(prose(int(rng.integers(25, 200))))) for i in range(30)]
    rows += [(100 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(0, 12)] + [(90, " ".join(base)), (90, " ".join(base)), (None, " ".join(base))]
    rows += [(200 + i, "\n".join([" ".join(prose(40)), "  A Shared Footer line ", " ".join(prose(30)), "" if i % 2 else "a shared footer LINE"])) for i in range(12)]
    rows += [(300 + i, " ".join(prose(35)) + " " + shared + " " + " ".join(prose(35 + i))) for i in range(5)]
    rows += [(None, None), (400, None), (401, ""), (402, " \n "), (403, "short"), (404, "x " * 60), (405, "# * $ % & | < > " * 10), (406, "\n".join(["- " + " ".join(prose(8)) for _ in range(10)]))]
    rows += [(5, "another text under a used id: " + " ".join(prose(60))), (407, " ".join(prose(20_000)))]
    return rows


def test_pipeline_stages_against_brute_force(spark):
    rows = _pipeline_rows()
    extra = "lang string, h1 string, `row` long, spans string, c0 string, gone int, sid long, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "h", 1, "s", "c", 2, 3, len(t or "")) for i, t in rows], f"doc_id long, text string, {extra}")
    kept, columns = rows, docs.columns
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (
        lambda r: [x for x in r if _passes(x[1])], lambda r: [x[:2] for x in _kept_lines(r, 10)], lambda r: _one_of_each(r, 5, 80), lambda r: _without_repeats(r, 50),
    ), strict=False):
        out, kept = stage(spark, docs, SF), brute(kept)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        same([(r.doc_id, r.text) for r in docs.collect()], kept)
        assert all(r.n_chars == len(r.text) and (r.lang, r.h1, r.row, r.c0) == ("en", "h", 1, "c") for r in docs.collect() if r.text is not None)
        assert stage(spark, docs.limit(0), SF).isEmpty()
    assert 30 < len(kept) < len(rows) - 15 and any(d == 5 and t.startswith("another") for d, t in kept) and sum(d == 90 for d, _ in kept) == 1
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    packed = defaultdict(list)
    for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect():
        packed[r.sequence_id].append((r.offset, r.length))
    assert sum(n for p in packed.values() for _, n in p) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in kept)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_take_any_rows(spark, name):
    """Nulls in any column, blank texts, repeated rows; each stage as the first."""
    docs = spark.createDataFrame([(None, None, None), (1, None, "x"), (1, "", None), (2, " \n", "x"), (2, " \n", "x"), (3, "one", "x"), (3, "one", "x"), (3, "two", "x")], "doc_id long, text string, lang string")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert got == {"quality rules": [], "n-gram Jaccard join": [-1, 1, 1, 2, 2, 3, 3]}.get(name, [-1, 1, 1, 2, 2, 3, 3, 3])


def test_spelling_and_width_of_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Same line\nown words here", 0), (2, "same LINE\nother words", 0)]
    docs = spark.createDataFrame(rows, "Doc_ID int, TEXT string, row int")
    same(lines.dedup_lines(docs, least=2).collect(), [(1, "own words here", 0), (2, "other words", 0)])
    assert lines.dedup_lines(docs, least=2).columns == docs.columns == substrings.dedup_substrings(docs).columns == jaccard.dedup_groups(docs).columns
    same(lines.dedup_lines(docs, least=2, report=True).select("doc_id", "n_dropped").collect(), [(1, 1), (2, 1)])
    same(substrings.dedup_substrings(docs, report=True).select("doc_id", "n_words").collect(), [(1, 5), (2, 4)])
    for f in (jaccard.jaccard_groups, licenses.scan_licenses, quality.quality_report, lambda d: packing.pack(d, path), lambda d: pieces.encode_pieces(d, public_tokenizers.path("piece_bpe_32k.model"))):
        assert sorted(r.doc_id for r in f(docs).select("doc_id").distinct().collect()) == [1, 2]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n <> 1024").count() <= 1 and out.select("doc_id").distinct().count() <= kept.count()


def test_parity_sketches_of_unlike_length():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**54, 5000).astype(np.uint64)

    def sketch(x, size):
        bits = np.bincount((jaccard.mix(x) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        return np.packbits(bits.astype(np.uint8)).tobytes()

    for small in (512, 1024, 4096):
        assert jaccard._apart(sketch(a, small), sketch(a, 8192)) == 0
        assert jaccard._apart(sketch(a[7:], small), sketch(a, 8192)) <= 7
