"""Small fixtures against plain Python: nulls, empties, long texts, ties, repeats, clashing names, empty tables."""

import hashlib
import json
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrastat.llm import pfor
from terrastat.llm.decontam import decontaminate
from terrastat.llm.exact_dedup import exact_dedup
from terrastat.llm.html_render import extract_text, visible_text
from terrastat.llm.lattice_lm import Lattice, by_length, lattice_scores, vocabulary
from terrastat.llm.minhash import near_duplicates
from terrastat.llm.mixing import mix_sources
from terrastat.llm.queries import tokenizer_file
from terrastat.llm.token_output import PieceEncoder, read_token_files, token_output, write_token_files
from terrastat.llm.toxicity import held_out, toxic_rows, train_toxicity, with_toxicity
from terrastat.llm.url_filter import ALPHABET, judge_urls
from terrastat.llm.warc import archive_pages, assemble_transactions, base32_digest, read_archives, write_archives

SCHEMA = "doc_id long, text string, source string, node long, size long, keep_id string, score double, bucket string"


def docs(spark, rows, sources=None):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, sources[k] if sources else "s", 1, 2, "x", 0.5, "b") for k, (i, t) in enumerate(rows)], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


RNG = np.random.default_rng(5)
LONG = " ".join(f"w{x}" for x in RNG.integers(0, 4000, 30_000))
ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, "One two"), (5, "oNE TWO"), (6, LONG), (7, LONG.upper()), (8, "É é"), (9, "é é"), (4, "One two"), (None, "One two"), (None, None)]


def test_exact_dedup(spark):
    for every in (True, False):
        got = exact_dedup(docs(spark, ODD), digest_all=every).collect()
        assert len(got) == len(ODD)
        by = {r.doc_id: r for r in got if r.doc_id is not None}
        assert by[5].kept and by[5].group_size == 4 and by[4].keep_id == 5 and not by[4].kept
        assert by[2].kept and by[1].keep_id == 2 and by[1].group_size == 3
        assert by[7].group_size == 2 and by[6].keep_id == 7
        assert by[8].kept and by[9].kept
        if every:
            assert by[6].text_sha256 == hashlib.sha256(low(LONG).encode()).hexdigest()
    assert exact_dedup(docs(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, "a " * (1 + i % 7)) for i in range(600)] + [(None, "x y"), (700, None), (700, None)]
    src = ["A"] * 400 + ["B"] * 150 + [None] * 50 + ["B", "A", "A"]
    d = docs(spark, rows, src)
    got = mix_sources(d).collect()
    assert len(got) == len(rows) and all(r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 for r in got)
    total = sum(r.size for r in got)
    targets = {r.source: r.target for r in got}
    sizes = {r.source: r.source_size for r in got}
    assert sum(targets.values()) == pytest.approx(total)
    assert targets[None] == min(3 * sizes[None], targets[None])
    for s in targets:
        assert abs(sum(r.taken for r in got if r.source == s) - targets[s]) <= 8
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(d.repartition(5)).collect()))
    assert mix_sources(docs(spark, [])).count() == 0


def test_mixing_meets_its_targets_among_copies_of_one_row(spark):
    """Hashes can't split rows that repeat id and text; as many are taken as come nearest."""
    for key, texts in ((5, ["a b c d e"]), (None, ["a b c d e"]), (5, [f"a b c d{i % 20}" for i in range(20)])):
        rows = [(key, texts[i % len(texts)]) for i in range(400)]
        d = docs(spark, rows, ["A" if i < 200 else "B" for i in range(400)])
        got = mix_sources(d.repartition(4)).collect()
        assert len(got) == 400
        for s in "AB":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5 and max(r.repeats for r in mine) <= 3
        assert sorted(map(str, got)) == sorted(map(str, mix_sources(d.repartition(3)).collect()))
    long = mix_sources(docs(spark, [(1, LONG), (2, "x")])).collect()
    assert sorted((r.doc_id, r.size) for r in long) == [(1, 30_000), (2, 1)]


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = word.findall(low(text)), set(), set()
    for key, t in items:
        v = word.findall(low(t))
        k = min(window, len(v))
        for s in range(len(v) - k + 1) if v else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[s : s + k]:
                    hit |= set(range(p, p + k))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    items = [(1, item), (2, "the the the"), (10, "Só"), (11, None), (12, "--"), (3, item)]
    rows = [(1, f"pre {item.upper()} post"), (2, "the the the the cat the"), (3, item[:60]), (4, None), (5, ""), (6, LONG + " " + item + " " + LONG), (7, "só x SÓ"), (8, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (8, "other"), (1, f"pre {item.upper()} post")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("word", F.lit("c"))
    for most in (64 << 20, 2000, 0):
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate(docs(spark, rows), bench, broadcast_bytes=most).collect())
        want = []
        for i, t in rows:
            n, h, f = brute_hits(t, items)
            want.append((i, n, h, tuple(f)))
        assert got == sorted(want)
    assert decontaminate(docs(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate(docs(spark, []), bench).count() == 0


def test_probes_stay_linear_in_long_items(spark):
    """An item of 20,000 words: each probe holds less than two windows, equal windows are one probe."""
    from terrastat.llm.decontam import window_probes

    words = [f"q{x}" for x in RNG.integers(0, 3000, 20_000)]
    for text in (words, ["the"] * 20_000):
        items = spark.createDataFrame([("1", text, 1)], "item_id string, words array<string>, __item long")
        probes = window_probes(items, spark.createDataFrame([], "word string, n long"), 10)
        total, widest, kinds = probes.agg(F.sum(F.size("part")), F.max(F.size("part")), F.count_distinct("part", "at", "hi")).first()
        assert widest < 20 and total <= 10 * 20_000 and (kinds == 1 or text is words)
    doc = " ".join(words[5000:5100])
    d = docs(spark, [(1, "x " + doc + " y"), (2, "the " * 50), (3, "the " * 9)])
    got = decontaminate(d, spark.createDataFrame([(1, " ".join(words)), (2, "the " * 20_000)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_hit, r.item_ids) for r in got) == [(1, 100, ["1"]), (2, 50, ["2"]), (3, 0, [])]


def brute_components(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    return [(i, len(s), min(rows[k][0] for k in range(len(rows)) if label[k] == label[j])) for j, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(spark):
    base = [f"k{x}" for x in RNG.integers(0, 9000, 120)]
    rows = [(100 + i, " ".join(w if RNG.random() > p else "new" + str(RNG.integers(1e6)) for w in base)) for i, p in enumerate(RNG.random(40) * 0.08)]
    rows += [(1, None), (2, ""), (3, "a b"), (4, "A B"), (5, "a b c d e"), (6, LONG), (7, LONG + " tail"), (8, "  "), (90, " ".join(base).upper()), (91, " ".join(base))]
    got = near_duplicates(docs(spark, rows), shingle_words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 4))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(docs(spark, [])).count() == 0
    assert {r.component_id for r in near_duplicates(docs(spark, [(None, "a b c d e f"), (3, "a b c d e f")])).collect()} == {3}


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    bad = ["vile", "foul", "crud"]
    rows, labels = [], []
    for i in range(900):
        w = [f"c{x}" for x in rng.integers(0, 300, 40)]
        if i % 4 == 0:
            w[5] = w[9] = bad[i % 3]
            w[20] = bad[(i + 1) % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    y = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    d = docs(spark, rows)
    model = train_toxicity(d, y.where(~held_out()))
    plain = d.drop("score")
    got = {r.doc_id: r.score for r in with_toxicity(plain, model).collect()}
    test = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in test]) > 0.95
    assert len(model[0]) < 2000
    odd = with_toxicity(docs(spark, ODD).drop("score"), model)
    assert odd.count() == len(ODD) and odd.where("score between 0 and 1").count() == len(ODD)
    gone = toxic_rows(plain, model)
    assert gone.columns == ["doc_id", "text_hash"] and sorted(r[0] for r in gone.collect()) == sorted(i for i, x in got.items() if x >= 0.5)
    assert toxic_rows(docs(spark, ODD), model).count() == odd.where("score >= 0.5").count()
    assert toxic_rows(docs(spark, ODD), model, 0.0).count() == len(ODD)
    empty = train_toxicity(d, y.limit(0))
    assert [r[0] for r in with_toxicity(plain.limit(2), empty).select("score").collect()] == [0.5, 0.5]
    assert with_toxicity(docs(spark, []), model).count() == 0


def slow_features(text, bits):
    """Coordinates of a text's words, adjacent pairs and pairs one word apart, with plain integers."""
    from terrastat.llm import toxicity, wordhash

    top = 2**64

    def mixed(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % top
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) % top
        return h ^ (h >> 31)

    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))]
    h = [mixed(sum(int(wordhash._BYTE[c]) * pow(0x9E3779B97F4A7C15, k, top) for k, c in enumerate(w)) % top) for w in words]
    both = lambda gap, salt: [mixed((a * int(salt) + b) % top) for a, b in zip(h, h[gap:])]  # noqa: B905, E731
    return sorted({x >> (64 - bits) for x in h + both(1, toxicity._PAIR) + both(2, toxicity._SKIP)})


def test_toxicity_features_and_ftrl_against_plain_python():
    from terrastat.llm import toxicity

    texts = ["", "one", "One two", "A b-c d,e f", "é\u00a0É x1 _y_", "w " * 50, None, "  ", "last one two"]
    batch = pa.RecordBatch.from_pydict({"at": list(range(len(texts))), "label": [1.0] * len(texts), "text": pa.array(texts)})
    found = [x for b in toxicity._featurise([batch]) for x in b.column("features").to_pylist()]
    assert [sorted(x) for x in found] == [slow_features(t, toxicity.BITS) for t in texts]

    rows = [(float(RNG.random() < 0.3), np.unique(RNG.integers(0, 40, RNG.integers(0, 12))).astype(np.int32)) for _ in range(300)]
    rows = [(max(y, float(3 in x)), x) for y, x in rows]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.4, 0.1
    at, w, bias = toxicity.ftrl(iter(rows), 6, alpha, beta, l1, l2)
    z, n, bz, bn = dict.fromkeys(range(64), 0.0), dict.fromkeys(range(64), 0.0), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for y, x in rows:
        ws, b = {i: weight(i) for i in x.tolist()}, -bz / ((beta + math.sqrt(bn)) / alpha)
        g = 1 / (1 + math.exp(-(sum(ws.values()) + b))) - y
        for i in ws:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * ws[i]
            n[i] += g * g
        bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b
        bn += g * g
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in z if weight(i)}, rel=1e-5)
    assert bias == pytest.approx(-bz / ((beta + math.sqrt(bn)) / alpha)) and 3 in at
    order = [x for _, x in toxicity.epochs([(0, i) for i in range(50)], 3)]
    assert sorted(order) == sorted(list(range(50)) * 3) and order[:50] != order[50:100]


def test_toxicity_samples_are_bounded(spark):
    rows = [(i, f"good w{i}") for i in range(60)] + [(7, "bad thing " * 20)] * 40 + [(61, "huge " * 50_000)]
    y = spark.createDataFrame([(i, int(i == 7)) for i in range(62)], "doc_id long, toxic int")
    d = docs(spark, rows).drop("score")
    small = train_toxicity(d, y, max_rows=62, max_bytes=2000)
    assert with_toxicity(d.where("doc_id = 3"), small).first()["score"] < 0.5
    assert all(np.array_equal(a, b) for a, b in zip(small, train_toxicity(d.repartition(5), y, max_rows=62, max_bytes=2000), strict=True))


def test_pfor_blocks():
    for ids in ([], [0], [7] * 3000, RNG.integers(0, 50_257, 5000).tolist(), [2**32 - 1, 0] * 700, [5] * 1000 + [2**31] * 30):
        a = np.array(ids, np.uint32)
        blocks = pfor.encode_blocks(a)
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *map(pfor.decode_block, map(memoryview, blocks))]), a)


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["  a  b ", " \n\n x\t\ty 's it's", "<|endoftext|> y", "é\u00a0 ü\n\n", "x\r\n  y", "\u2003a \u3000b", "a\x1cb c", LONG]
    rows = [(50 - i, t) for i, t in enumerate(texts)] + ODD
    t = Tokenizer.from_file(tokenizer_file())
    got = sorted(token_output(docs(spark, rows), tokenizer_file()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, *sorted(i for i, _ in rows if i is not None)]
    want = {}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert all((r.n_tokens, r.ids_crc32) in want[r.doc_id] for r in got)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    m = write_token_files(docs(spark, rows), str(tmp_path / "f"), tokenizer_file())
    assert read_token_files(m, with_ids=True).where("doc_id = 2").first()["ids"] == [0]
    assert token_output(docs(spark, []), tokenizer_file()).count() == 0
    for path, n in m.select("path", "n_docs").collect():
        whole = list(pfor.read_documents(path))
        ids, counts = sum((x[0] for x in whole), []), np.concatenate([x[1] for x in whole])
        flat, ends = np.concatenate([x[2] for x in whole]), np.concatenate([[0], np.cumsum(counts)])
        for a, b in ((0, n), (n // 2, n), (n - 1, n + 5), (0, 1), (n, n)):
            part = pfor.read_slice(path, a, b)
            assert part[0] == ids[a:b] and np.array_equal(part[1], counts[a:b]) and np.array_equal(part[2], flat[ends[a] : ends[min(b, n)]])


def test_pieces_equal_whole_texts():
    e = PieceEncoder(tokenizer_file())
    texts = ["", None, "a", " a b", "\n\na", "b \n", "\U0001f600 x\u0301 y"] * 3
    ids = np.concatenate([x[3] for x in e.encode(pa.array(texts))]).tolist()
    assert ids == [i for x in texts for i in e.tokenizer.encode(x or "", add_special_tokens=False).ids]


def brute_delta(train, order, text):
    """Log-likelihood difference of a url by counting substrings."""
    def prob(label, ctx, c):
        p = 1 / ALPHABET
        for k in range(order + 1):
            g = ctx[order - k :]
            seen = [u[i + order] for u in (("\x02" * order) + t for t, lab in train if lab == label) for i in range(len(u) - order) if u[i + order - k : i + order] == g]
            if not seen:
                continue
            p = (seen.count(c) + len(set(seen)) * p) / (len(seen) + len(set(seen)))
        return p

    u = "\x02" * order + text
    return sum(math.log(prob("allow", u[i : i + order], u[i + order])) - math.log(prob("block", u[i : i + order], u[i + order])) for i in range(len(text)))


def test_url_filter(spark):
    urls = ["http://a.example.com/x", "https://www.example.com/en/1", "http://example.com/en/2", "http://b.net/es/3", "http://c.net/fr/", "http://b.org/ok", "nourl", None, "", "HTTP://Q.ORG", "ftp://u.org?x://y", "http://b.org/ok", "http://x.com", "http://d.net/en#/es/"]
    d = spark.createDataFrame([(i if i != 5 else None, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {(r.page_id, r.host, r.path): r for r in judge_urls(d, order=2).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert [by[i].verdict for i in range(5)] == ["allow", "allow", "block", "block", "block"]
    assert by[0].rule == "com/" and by[1].rule == "www.example.com/en/" and by[6].host == "" and by[7].path == ""
    assert (by[9].host, by[9].path) == ("q.org", "") and (by[10].host, by[10].path) == ("u.org", "") and by[12].rule is None
    assert by[13].rule is None and by[13].path == "/en"
    train = [(u, by[i].verdict) for i, u in enumerate(urls[:5])]
    for i in (11, 6):
        assert by[i].score == pytest.approx(brute_delta(train, 2, urls[i]) / len(urls[i]), abs=1e-6)
        assert by[i].verdict == ("allow" if by[i].score >= by[i].threshold else "block")
    long = "http://b.org/" + "xyz/" * 40_000
    more = d.select("page_id", "url").union(spark.createDataFrame([(50, long), (51, long)], "page_id long, url string"))
    far = [r for r in judge_urls(more, order=2).collect() if r.page_id in (50, 51)]
    assert len(far) == 2 and far[0].verdict == far[1].verdict and far[0].path == long[12:]
    tie = [r for r in judge_urls(more, order=2).collect() if r.rule is None and r.score == r.threshold]
    assert all(r.verdict == "allow" for r in tie)
    none = judge_urls(d.where("page_id > 5 and page_id < 12")).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.score for r in none} == {0.0}
    assert judge_urls(d.limit(0)).count() == 0


def all_cuts(word, logp):
    if not word:
        return [0.0]
    return [logp[word[:k]] + x for k in range(1, len(word) + 1) if word[:k] in logp for x in all_cuts(word[k:], logp)]


def test_lattice_sums_all_segmentations(monkeypatch):
    from terrastat.llm import lattice_lm

    pieces = [b" a", b" ab", b"a", b"b", b"ba", b"abb", b" "]
    logp = np.log(np.array([0.2, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1]))
    table = dict(zip(pieces, logp, strict=True))
    lattice = Lattice(pieces, logp)
    words = [b"ab", b"abba", b"bab", b"a", b"abbabba"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    for at, m in by_length(data, ends - [len(w) for w in words], ends):
        for i, v in zip(at, lattice.forward(m)[-1], strict=True):
            assert v == pytest.approx(np.logaddexp.reduce(all_cuts(b" " + words[i], table)))
        n, like = lattice.expected(m, np.ones(len(at)))
        assert (n * [len(p) for p in pieces]).sum() == pytest.approx(m.size)
        assert like == pytest.approx(lattice.forward(m)[-1].sum())
    import public_tokenizers

    big_pieces, big_logp = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    big = Lattice(big_pieces, big_logp)
    for size in (3, 20, 63, 64, 90):
        m = np.full((40, size), 0x20, np.uint8)
        m[:, 1:] = RNG.integers(97, 123, (40, size - 1))
        m[0, 1:] = RNG.integers(0, 256, size - 1)
        for weights in (np.ones(40), RNG.integers(1, 9, 40).astype(float)):
            uses, like = big.expected(m, weights)
            assert like == pytest.approx(big.forward(m)[-1] @ weights) and (uses * [len(p) for p in big_pieces]).sum() == pytest.approx(size * weights.sum())
            faint = Lattice(big_pieces, big_logp - 30)  # products underflow
            assert np.isfinite(faint.expected(m, weights)[0]).all() and faint.expected(m, weights)[1] == pytest.approx(faint.forward(m)[-1] @ weights)
            monkeypatch.setattr(lattice_lm, "SHORT", 0)
            assert np.allclose(big.expected(m, weights)[0], uses, rtol=1e-9, atol=1e-12)
            monkeypatch.setattr(lattice_lm, "SHORT", 64)


def brute_lattice(path, train, tolerance):
    """(log-probability of a word, of the end) after EM over all segmentations, each listed and weighed by itself."""
    pieces, logp = vocabulary(path)
    place = {p: i for i, p in enumerate(pieces)}

    def cuts(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if rest[:k] in place:
                for more in cuts(rest[k:]):
                    yield [place[rest[:k]], *more]

    counts: dict = {}
    for words in train:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    ways = {w: list(cuts(b" " + w.encode())) for w in counts}
    logp, end, before = logp.copy(), math.log(0.01), -math.inf
    while True:
        total, like = np.full(len(pieces), 0.05), 0.0
        for w, c in counts.items():
            p = [math.exp(sum(logp[i] for i in x)) for x in ways[w]]
            like += c * math.log(sum(p))
            for q, x in zip(p, ways[w], strict=True):
                for i in x:
                    total[i] += c * q / sum(p)
        logp, end = np.log(total / (total.sum() + len(train))), math.log(len(train) / (total.sum() + len(train)))
        if like - before < tolerance * abs(like):
            break
        before = like
    return lambda w: math.log(sum(math.exp(sum(logp[i] for i in x)) for x in cuts(b" " + w.encode()))), end


@pytest.mark.parametrize("frequent", [1 << 19, 3, 0])
def test_lattice_scores(spark, frequent):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    short = [(i, t if t not in (LONG, LONG.upper()) else " ".join(LONG.split()[:400])) for i, t in ODD]
    rows = [(i, f"The cat{i % 3} sat ON mat {i % 5}") for i in range(40)] + short + [(11, "zebra"), (11, "zebra"), (11, "gnu")]
    got = lattice_scores(docs(spark, rows).repartition(3), path, frequent=frequent).collect()
    assert len(got) == len(rows)
    tok = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c: dict = {}
    for i, x in tok:
        for w in x if not held(i) else ():
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    word, end = brute_lattice(path, [x[:-1] for i, x in tok if not held(i)], 1e-2)
    known = {w: word(w) for w in {w for _, x in tok for w in x[:-1]}}
    want = sorted((str(i), held(i), len(x), sum(w in c for w in x), sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in x), (sum(known[w] for w in x[:-1]) + end) / math.log(10)) for i, x in tok)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in have], [x[4:] for x in want], rtol=1e-9, atol=1e-6)
    assert {r.train_tokens for r in got} == {n}
    assert lattice_scores(docs(spark, []), path).count() == 0
    pieces, logp = vocabulary(path)
    assert np.exp(logp).sum() == pytest.approx(1) and len(set(pieces)) == len(pieces)


def test_caches_forget_and_stay_right(monkeypatch):
    from terrastat.llm import lattice_lm, token_output

    monkeypatch.setattr(lattice_lm, "CACHE_WORDS", 50)
    known, asked = lattice_lm.Known(), 0
    for _ in range(40):
        keys = np.unique(RNG.integers(0, 200, 30).astype(np.uint64))

        def make(new, keys=keys):
            nonlocal asked
            asked += new.sum()
            return keys[new] * 0.5

        assert np.array_equal(known.get(keys, make), keys * 0.5)
        assert len(known.keys) < 120
    assert asked > 200
    monkeypatch.setattr(token_output, "CACHE_PIECES", 40)
    e = PieceEncoder(tokenizer_file())
    for k in range(20):
        texts = [" ".join(f"w{x}" for x in RNG.integers(0, 300, 30)) + f"\n {k}" for _ in range(3)]
        ids = np.concatenate([x[3] for x in e.encode(pa.array(texts))]).tolist()
        assert ids == [i for x in texts for i in e.tokenizer.encode(x, add_special_tokens=False).ids]
    assert len(e.keys) < 200


PAGES = [(1, "http://a/x", "<p>x"), (2, None, None), (3, "http://b", ""), (4, "http://c\r\nEvil: 1", "<p>x"), (5, "u", "é" * 5000), (None, "http://n", "<p>x")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "q") for r in rows], "page_id long, url string, html string, type string, payload string")


def test_warc_round_trip(spark, tmp_path):
    d = pages(spark, PAGES)
    got = archive_pages(d).collect()
    assert len(got) == len(PAGES)
    by = {r.response["headers"].get("X-Capture-Key"): r for r in got}
    assert by["1"].response["type"] == "response" and by["4"].response["type"] == "revisit" and by["3"].response["type"] == "revisit"
    assert by["4"].response["refers_to"] == by["1"].capture_id and by["4"].response["payload_bytes"] == 4
    assert bytes(by["5"].response["payload"]).decode() == "é" * 5000
    assert by["5"].response["payload_digest"] == base32_digest(("é" * 5000).encode()) and len(by["5"].metadata) == 1
    assert by["1"].request["concurrent_to"] == [by["1"].capture_id] and by[None].response["type"] == "revisit"
    assert archive_pages(d, least_bytes=5).where("response.type = 'revisit'").count() == 0
    files = write_archives(d, str(tmp_path / "w"))
    assert read_archives(files).groupBy("type").count().where("type = 'metadata'").first()["count"] == len(PAGES)
    assert archive_pages(pages(spark, [])).count() == 0


def test_warc_ids_that_repeat_or_are_null(spark):
    rows = [(7, "u", "<p>x")] * 3 + [(9, "u", "<p>x"), (None, "v", "<p>x"), (None, "v", None), (None, None, ""), (7, "u", "other"), (8, "u", "w " * 400_000)]
    got = archive_pages(pages(spark, rows)).collect()
    assert len(got) == len(rows) == len({r.capture_id for r in got})
    assert all(r.request["concurrent_to"] == [r.capture_id] and len(r.metadata) == 1 for r in got)
    kinds = sorted((r.response["headers"].get("X-Capture-Key") or "", r.response["type"], r.response["payload_bytes"], r.response["headers"].get("X-Refers-To-Key")) for r in got)
    assert kinds == sorted([("7", "response", 4, None)] * 3 + [("9", "revisit", 4, "7"), ("", "revisit", 4, "7"), ("", "response", 0, None), ("", "response", 0, None), ("7", "response", 5, None), ("8", "response", 800_000, None)])


def test_warc_cut_off_archives_are_errors(tmp_path):
    import gzip
    import io

    from terrastat.llm.warc import parse_records

    one = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", mtime=0)
    assert [b for _, b in parse_records(io.BytesIO(one + one))] == [b"abc", b"abc"]
    assert list(parse_records(io.BytesIO(b""))) == []
    for keep in (1, 11, 20, len(one) - 1):
        with pytest.raises(ValueError, match="inside a record"):
            list(parse_records(io.BytesIO(one + one[:keep])))


def test_transactions_by_either_end(spark):
    from terrastat.llm.warc import RECORD

    row = lambda i, t, c: (i, t, None, None, c, None, None, None, {}, None, None)
    r = spark.createDataFrame([row("m", "response", ["q"]), row("q", "request", []), row("d2", "metadata", ["m"]), row("d1", "metadata", ["m"]), row("lost", "metadata", ["none"]), row("alone", "revisit", [])], RECORD)
    got = {x.capture_id: x for x in assemble_transactions(r).collect()}
    assert set(got) == {"m", "alone"} and got["m"].request["record_id"] == "q"
    assert [x["record_id"] for x in got["m"].metadata] == ["d1", "d2"] and got["alone"].request is None and got["alone"].metadata == []


def test_html_layout():
    assert visible_text("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\nd"
    assert visible_text("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>") == "* x\n* y\n  3. z\n  4. w"
    assert visible_text("<table><tr><td>1<td>22<tr><th>333<td>4</table>") == "1    22\n333  4"
    assert visible_text("a<script>no</script><b hidden>no</b><i style='DISPLAY : none'>no</i><!-- no -->b") == "ab"
    assert visible_text("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>") == "yes"
    assert visible_text("<pre> k\n  l</pre>") == " k\n  l"
    assert visible_text("&lt;x&gt; a &amp; b<br>c&nbsp;d") == "<x> a & b\nc d"
    assert visible_text("<head><title>t</title></head><body>x</body>") == "x"
    assert visible_text("<details><summary>s</summary>no</details><details open>in</details>") == "s\nin"
    assert visible_text("a < b <unclosed") == "a < b <unclosed"
    assert visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert visible_text("<a href='x>y'>q</a></p>z</table>") == "q\n\nz"


def test_html_keeps_every_visible_word(spark):
    words = [f"w{i}" for i in range(400)]
    tags = ["p", "div", "li", "td", "b", "h2", "ul", "table", "tr", "span", "dd"]
    html = "".join(f"<{tags[i % 11]}>{w} " + (f"</{tags[(i * 7) % 11]}>" if i % 3 else "") for i, w in enumerate(words))
    assert sorted(visible_text(html).replace("*", " ").split()) == sorted(words)
    d = pages(spark, [(1, "u", html), (None, "u", None), (2, "u", ""), (2, "u", "")])
    got = extract_text(d).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id != 1] == ["", "", ""]
    assert extract_text(d.limit(0)).count() == 0
    assert json.dumps([r.n_chars for r in got if r.page_id == 1])


def test_html_formulas_drawings_and_objects():
    assert visible_text("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>") == "a x=1 b"
    assert visible_text("<math><semantics><mi>x</mi><annotation encoding='t'>no</annotation><annotation-xml>no</annotation-xml></semantics></math>y") == "xy"
    assert visible_text("<svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs><style>no</style><script>no</script><g><text>a</text><text>b</text></g></svg>") == "a b"
    assert visible_text("<svg><defs/><title/><text>a<tspan>b</tspan></text><foreignObject><div>c</div></foreignObject></svg>d") == "ab\nc\nd"
    assert visible_text("<svg><text display='none'>no</text><text visibility='hidden'>no</text><text><![CDATA[a<b]]></text></svg>") == "a<b"
    assert visible_text("<svg><defs><p>out</p>") == "out"
    assert visible_text("<object data='x'><param name='y'>instead</object>") == "instead"
    assert visible_text("<defs>a</defs> <desc>b</desc> <annotation>c</annotation>") == "a b c"


def test_html_quotes_in_tags():
    assert visible_text("<p title=it's>Hello there</p><p>don't go</p>tail") == "Hello there\n\ndon't go\n\ntail"
    assert visible_text("""<p title=""x"">a</p>b<i title='>'c">d</i>""") == "a\n\nbd"
    assert visible_text("""<p it's>a</p><b "x>b's</b> <i title = '>'>c</i><u title=>d</u>""") == "a\n\nb's cd"
    assert visible_text("""<i a=b" hidden>no</i><i ='x' hidden>no</i><i a="b"hidden>no</i><i title="x hidden>y">a</i>""") == "a"
    assert visible_text("<a href='x>never ends") == "<a href='x>never ends"
    assert visible_text("<svg><g id=a/><text>b</text></g></svg>") == "b"


def test_sketch_bound_adds_nothing_to_the_band_miss():
    from math import comb

    from terrastat.llm import minhash

    n, p = minhash.BANDS * minhash.ROWS, 0.2 * 15 / 16
    lost = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(minhash.most_differences(80) + 1, n + 1))
    assert lost < 1e-3 * (1 - 0.8**minhash.ROWS) ** minhash.BANDS


def test_html_comments_that_end_at_once():
    assert visible_text("<p>a</p><!--><p>b</p>") == "a\n\nb"
    assert visible_text("a<!--->b<!-- x -->c<!--x--!>d</>e</ no>f") == "abcdef"


def test_html_visibility_below_the_layout_depth():
    deep = "<div>" * 250
    assert visible_text(deep + "<p style='display:none'>secret</p>vis") == "vis"
    assert visible_text(deep + "<p hidden>no<p>yes</div>after") == "yes\nafter"
    assert visible_text("<div style='visibility:hidden'>" + "<i>" * 300 + "no<i style='visibility:visible'>ok") == "ok"
    assert visible_text("<i>" * 300 + "<details><summary>s</summary>no</details>z") == "s\nz"
    assert visible_text("<ul><li>" * 300 + "<b hidden>x</b>y<table><tr><td>p<td>q").split()[-3:] == ["y", "p", "q"]
    assert visible_text("<b style='x-display:none'>a</b><b style='display : none ! important'>no</b>") == "a"


def test_html_tables_and_list_values():
    assert visible_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert visible_text("<table><tr><th colspan=2>long head<th>x<tr><td>1<td>2<td>3</table>") == "long head  x\n1  2  3"
    assert visible_text("<table><tr><td>long<td><td>x<tr><td>a<td>b<td>c</table>") == "long     x\na     b  c"
    assert visible_text("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert visible_text("<ol reversed><li>a<li hidden>no<li>b</ol><ol start=-2><li>c</ol>") == "2. a\n1. b\n\n-2. c"


@pytest.mark.parametrize("part", ["<a '", "<a x ", "<a b='", "<a b=\"' ", "<a", "<p>", "</b>", "<li>", "<svg><b>", "<table><tr><td>", "<ul><li>", "<!", "<p hidden>"])
def test_html_hostile_pages_take_linear_time(part):
    from time import process_time

    def seconds(n):
        began = process_time()
        visible_text(part * n + ' b=">')
        return process_time() - began

    n = 200_000 // len(part)
    assert seconds(4 * n) < 12 * max(seconds(n), 0.02)


def independent_words(html):
    """Visible words of a well-formed page by the standard library's parser."""
    from html.parser import HTMLParser

    void = set("area base br col embed hr img input link meta param source track wbr".split())
    skip = set("head script style template noscript noembed noframes iframe audio video canvas datalist title".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.words = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            gone = tag in skip or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "") or (tag == "dialog" and "open" not in a)
            if tag not in void:
                self.open.append((tag, gone))

        def handle_endtag(self, tag):
            at = [i for i, (t, _) in enumerate(self.open) if t == tag]
            if at:
                del self.open[at[-1] :]

        def handle_data(self, data):
            if not any(g for _, g in self.open):
                self.words += re.findall(r"\w+", data)

    r = Reader()
    r.feed(html)
    r.close()
    return sorted(r.words)


def test_html_words_equal_an_independent_parser_on_all_pages(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        marks = len(re.findall(r"(?m)^\s*\d+\. ", visible_text(row.html)))
        got = re.findall(r"\w+", visible_text(row.html))
        want = independent_words(row.html or "")
        assert marks or "".join(sorted("".join(got))) == "".join(sorted("".join(want))), row.page_id


def test_html_query_keeps_odd_rows(spark):
    long = "<p>" + "word " * 200_000
    rows = [(1, "u", long), (1, "u", long), (None, None, None), (2, "u", "")]
    d = spark.createDataFrame([(*r, "c", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in extract_text(d).collect())
    assert got == [(0, 0, 0), (1, 999_999, 999_999), (1, 999_999, 999_999), (2, 0, 0)]


def test_lattice_looks_up_only_spans_that_may_be_pieces():
    from terrastat.llm.lattice_lm import Lattice

    pieces = [bytes([b]) for b in range(256)] + [b" ab", b"abc", b"bc", b" abcab"]
    lattice = Lattice(pieces, np.log(np.full(len(pieces), 1 / len(pieces))))
    words = np.frombuffer(b" abcabc xyzxyz abxabc", np.uint8).reshape(3, 7)
    looked, find = [], lattice.find
    lattice.find = lambda h: looked.append(len(h)) or find(h)
    got = {(row, a, b): pieces[k] for a, b, rows, found in lattice.arcs(words) for row, k in zip(rows.tolist(), found.tolist(), strict=True)}
    want = {(r, a, b): words[r, a:b].tobytes() for r in range(3) for a in range(7) for b in range(a + 1, 8) if words[r, a:b].tobytes() in pieces}
    assert got == want and sum(looked) < 2 * len(want)
    uses, like = lattice.expected(words, np.array([2.0, 1.0, 3.0]))
    again, same = lattice._expected_in_logs(words, np.array([2.0, 1.0, 3.0]))
    assert np.allclose(uses, again) and np.isclose(like, same)
