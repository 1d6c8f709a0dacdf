"""Line deduplication, spelling variants and conversation repair on small fixtures, against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrastat.llm import turns
from terrastat.llm.line_dedup import kept_lines, line_bitmaps
from terrastat.llm.queries import op11_spelling_variants, op12_line_dedup, op13_conversation_repair
from terrastat.llm.spelling import near_words, signatures, spelling_variants, words_of

SCHEMA = "doc_id long, text string, lines string, key string, n long, hash long, pos long, word string, form string, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, "w", "f", True) for i, t in rows], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# lines


def line_key(line):
    return low(line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, min_docs, min_chars=1, keep="none"):
    where = defaultdict(set)
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            where[line_key(line)].add((i is not None, i or 0, t or ""))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if len(line_key(line)) < min_chars or len(where[line_key(line)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LONG = "\n".join(f"line {k % 700} of many" for k in range(40_000))
LINES = (
    [(k, f"Shared  \n\nown {k}\n\t SHARED\r\n{'rare' if k < 2 else 'other'} line") for k in range(6)]
    + [(20, None), (21, ""), (22, "\n\n"), (23, "shared"), (23, "shared"), (24, "É\né"), (25, LONG), (26, LONG + "\nshared"), (None, "shared\nx"), (None, "shared\nx"), (23, "another\nshared\n"), (27, " \x0bshared\x0c")]
)


@pytest.mark.parametrize("min_docs", [2, 3, 8, 12])
def test_lines_of_many_documents_go(spark, min_docs):
    d = docs(spark, LINES)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in kept_lines(d, line_bitmaps(d, min_docs=min_docs)).collect()), key=str)
    assert got == brute_lines(LINES, min_docs)


def test_first_line_may_stay_and_short_keys_do(spark):
    rows = [(2, "a\nlonger\na"), (1, "x\na"), (3, "longer"), (None, "a")]
    d = docs(spark, rows)
    bits = {r.doc_id: r for r in line_bitmaps(d, min_docs=2, keep="first").collect()}
    assert set(bits) == {1, 2, 3}  # the null id comes first and keeps its a
    assert [(r.first, r.n) for r in bits[2].kept] == [(1, 1)] and bits[2].n_dropped == 2
    assert [(r.first, r.n) for r in bits[1].kept] == [(0, 1)] and bits[3].kept == [] and bits[3].n_lines == 1
    assert {r.doc_id for r in line_bitmaps(d, min_docs=2, min_chars=2).collect()} == {2, 3}
    assert line_bitmaps(docs(spark, [])).count() == 0 and kept_lines(docs(spark, []), line_bitmaps(d)).count() == 0
    with pytest.raises(ValueError):
        line_bitmaps(d, keep="last")


def test_repeated_lines_past_the_broadcast(spark, monkeypatch):
    from terrastat.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    d = docs(spark, LINES)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in kept_lines(d, line_bitmaps(d, min_docs=3)).collect()), key=str)
    assert got == brute_lines(LINES, 3)


# words


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute_variants(counts, ratio=10):
    forms, rows = {}, []
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v)) if others else None
        forms[w] = best if others and counts[best] >= ratio * n else None
        rows.append((w, n, len(others)))

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, forms[w] or "", root(w), n, k, counts[forms[w]] if forms[w] else -1) for w, n, k in rows)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


RANDOM = random.Random(11)
WORDS = {"".join(RANDOM.choice("abé") for _ in range(RANDOM.randint(1, 6))) for _ in range(250)}
COUNTS = {w: RANDOM.choice([2, 3, 20, 30, 200, 2000]) for w in sorted(WORDS)} | {"x" * 3000: 2, "x" * 3001: 40, "x" * 3000 + "yx": 7}


@pytest.mark.parametrize("parts,blocks", [(1, 4), (2, 3), (3, 1), (1, 6)])
def test_variants_against_all_pairs(spark, parts, blocks):
    words = spark.createDataFrame([(w, n, "k", "s", True) for w, n in COUNTS.items()], "word string, n long, key string, signature string, long boolean")
    assert rows_of(spelling_variants(words, parts=parts, blocks=blocks)) == brute_variants(COUNTS)
    pairs = {(r.a, r.b) for r in near_words(words, parts, blocks).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(COUNTS), 2) if near(a, b)}


def test_signatures_share_one_at_distance_two(spark):
    df = spark.createDataFrame([("kettle",), ("kattle",), ("kettles",), ("telkte",)], "word string")
    sets = {r.word: set(r.s) for r in df.select("word", signatures(F.col("word")).alias("s")).collect()}
    assert sets["kettle"] & sets["kattle"] and sets["kettle"] & sets["kettles"] and sets["kettle"] == sets["telkte"] and len(sets["kettle"]) == 6
    with pytest.raises(ValueError):
        signatures(F.col("word"), 1, 2)


def test_chains_of_forms_end_at_their_root(spark):
    chain = {"aaaa": 2, "aaab": 20, "aabb": 200, "abbb": 2000, "bbbb": 20_000, "bbbbc": 200_000}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {r.word: r.root for r in spelling_variants(words).collect()}
    assert set(got.values()) == {"bbbbc"}
    assert spelling_variants(words.limit(0)).count() == 0
    assert spelling_variants(spark.createDataFrame([(None, 4), ("solo", 2)], "word string, n long")).collect()[0].root == "solo"


def test_spelling_query(spark, tmp_path):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(8)) for _ in range(12)]
    rows = [(k, " ".join(rng.choice(stems).title() if rng.random() < 0.2 else rng.choice(stems) for _ in range(150)) + " 12abcdefgh_ijklmnop") for k in range(40)]
    rows += [(100, None), (101, ""), (None, " ".join(stems)), (7, "ab " * 5000)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert len(counts) > 15
    assert rows_of(op11_spelling_variants(spark, str(tmp_path))) == brute_variants(counts)
    assert [r.word for r in words_of(docs(spark, [(1, "Ab-cÀd 9e"), (2, None)])).collect()] == ["ab", "cÀd", "e"]


def test_line_query(spark, tmp_path):
    rows = [(k, f"a\nOnly {k}\nEnd of it ") for k in range(11)] + [(k + 50, "end OF it\nb") for k in range(3)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op12_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, d, sha(t)) for i, n, d, t in brute_lines(rows, 10))
    assert sum(r[2] for r in got) == 11 * 2 + 3


# conversations


def brute_repair(codes):
    """Cheapest (cost, audit) by search over all edits; codes are (initial, fault)."""
    from functools import lru_cache

    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @lru_cache(None)
    def best(i, q, inserts):
        out = [(0, "")] if i == len(codes) and q in (0, 3) else []
        if i < len(codes):
            initial, fault = codes[i]
            out.append(plus(2, "D", best(i + 1, q, 4)))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if initial in step[q]:
                    out.append(plus(more, "K", best(i + 1, step[q][initial], 4)))
                out += [plus(more + 1, "R", best(i + 1, step[q][r], 4)) for r in "ua" if r in step[q]]
        if inserts:
            out += [plus(5, "I", best(i, step[q][r], inserts - 1)) for r in "ua" if r in step[q]]
        return min(out) if out else (10**9, "")

    def plus(c, letter, rest):
        return c + rest[0], letter + rest[1]

    return best(0, 0, 4)


def test_repair_against_search():
    kinds = [(r, f) for r in "suax" for f in (None, "blank", "duplicate", "truncated")]
    code = {(r, f): chr(65 + 4 * "suax".index(r) + [None, "blank", "duplicate", "truncated"].index(f)) for r, f in kinds}
    cases = [c for n in range(3) for c in itertools.product(kinds, repeat=n)]
    rng = random.Random(5)
    cases += [tuple(rng.choice(kinds if rng.random() < 0.5 else [k for k in kinds if k[1] in (None, "truncated")]) for _ in range(rng.randint(3, 9))) for _ in range(1500)]
    for case in cases:
        assert turns.repair("".join(code[k] for k in case).encode()) == brute_repair(case), case


def brute_conversations(rows):
    grouped = defaultdict(list)
    for c, t, r, x in rows:
        grouped[c].append((t is not None, t if t is not None else 0, r if r is not None else " ", x if x is not None else " "))
    out = []
    for c, mine in grouped.items():
        mine.sort(key=lambda r: (r[:3], hashlib.md5(r[3].encode()).digest()))
        codes, seen = [], set()
        for _, _, role, text in mine:
            ink = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else None if ink[-1] in ".!?" else "truncated"
            seen.add((role, text))
            codes.append((role[:1], fault))
        ts = [t for known, t, _, _ in mine if known]
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = brute_repair(tuple(codes))
        stays, lines, i, at = len(audit) - audit.count("D"), [], 0, 0
        at = 1 - stays % 2
        for letter in audit:
            if letter != "D":
                role = mine[i][2] if letter == "K" else ("user", "assistant")[(at - 1) % 2]
                lines.append(f"{role}:{'' if letter == 'I' else mine[i][3]}")
                at += 1
            i += letter != "I"
        faults = Counter(f for _, f in codes)
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, "\n".join(lines)))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", "a", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, audit string, place int")


def conversation_rows():
    rng = random.Random(9)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            rows.append((c, t + (t > 4), role, rng.choice(["Yes.", "No!", "What?", "cut off", "  ", "", None, f"Text {rng.random()}. "])))
    rows += [(500, None, "user", "Null turn."), (500, None, None, "x."), (500, 3, "assistant", "Fine."), (500, 3, "assistant", "Fine."), (501, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hm."), (502, 5, "", "Empty role.")]
    rows += [(600, t, ["user", "assistant"][t % 2], "word " * 20_000 + f"{t}.") for t in range(4)] + rows[:9]
    return rows


def test_conversations_against_plain_python(spark):
    rows = conversation_rows()
    df = conversations(spark, rows).repartition(5)
    repairs = turns.repair_conversations(df)
    texts = {r.conv_id: r.repaired_sha256 for r in turns.repaired_digests(df, repairs).collect()}
    got = sorted(((*r, texts[r.conv_id]) for r in repairs.collect()), key=str)
    want = brute_conversations(rows)
    assert got == [(*w[:-1], sha(w[-1])) for w in want]
    made = defaultdict(list)
    for r in turns.repaired_rows(df, repairs).collect():
        made[r.conv_id].append((r.place, f"{r.role}:{r.text}", r.edit))
    for w in want:
        mine = sorted(made[w[0]])
        assert "\n".join(m[1] for m in mine) == w[-1] and "".join(m[2] for m in mine) == w[7].replace("D", "")
    empty = conversations(spark, [])
    assert turns.repair_conversations(empty).count() == 0 and turns.repaired_digests(empty, turns.repair_conversations(empty)).count() == 0


def test_a_long_conversation_is_dealt_in_pieces(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"Turn {t % 900}.") for t in range(6000)] + [(c, 0, "user", "Hi.") for c in range(2, 40)]
    df = conversations(spark, rows).repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {r.conv_id: r for r in turns.repair_conversations(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[1].duplicate == 5100 and got[1].gaps == 0 and got[1].audit == "K" * 900 + "D" * 5100 and got[1].cost == 10_200
    assert len(got) == 39 and got[2].audit == "D"


def test_conversation_query(spark, tmp_path):
    rows = conversation_rows()
    conversations(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        if f:
            hurt += [(c, t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)] * (2 if f == 3 else 1)
    want = [(*w[:-1], sha(w[-1])) for w in brute_conversations(hurt)]
    want += [(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in {r[0] for r in rows} - {r[0] for r in hurt}]
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r[c] for c in columns) for r in op13_conversation_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
