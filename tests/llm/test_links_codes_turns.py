"""SimHash near-duplicates, vector codes and turn repair against plain Python on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lodestone.llm import ngram_join as nj, simhash_dedup as sd, turn_repair as tr, vector_codes as vc
from lodestone.llm.common import steps, stored
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(300)]
TEXTS = [
    (1, "one two three four"),
    (1, "one two three four"),
    (2, "ONE two\tthree\n\n four "),
    (3, None),
    (4, ""),
    (5, " \t\r\n\x0b\x0c "),
    (6, "x"),
    (7, "x y"),
    (8, " ".join(WORDS)),
    (9, " ".join([*WORDS[:150], "other", *WORDS[151:]])),
    (10, " ".join(WORDS[:299])),
    (11, "a b Übär   c"),
    (12, "so so so so so so"),
    (None, "one two three four"),
    (None, "nothing like it here"),
    (13, " ".join(f"v{i % 977} ü{i}" for i in range(30_000))),
]


def _print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(values, linked):
    """The smallest place that each place reaches."""
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if linked(values[i], values[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(values))]


def _component_ids(rows):
    prints = [_print(t) for _, t in rows]
    roots = _classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    ids = [min((d for (d, _), r in zip(rows, roots) if r == own and d is not None), default=None) for own in roots]
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, ids)), key=repr)


@pytest.mark.parametrize("chunk", [None, 7])
def test_near_components(spark, monkeypatch, chunk):
    if chunk:
        assert sd.fingerprint_of(TEXTS[8][1].encode()) == _signed(_print(TEXTS[8][1]))
        monkeypatch.setattr(sd, "CHUNK_BYTES", chunk)
        for _, text in TEXTS[:-1]:
            assert sd.fingerprint_of((text or "").encode()) == _signed(_print(text))
        return
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("fp", "node", "fingerprint", "a.b")})
    got = [tuple(r) for r in sd.near_components(docs).collect()]
    assert sorted(got, key=repr) == _component_ids(TEXTS)
    assert sd.near_components(docs.filter("false")).count() == 0


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("radius", "few", "short"), [(3, 4096, 64), (3, 8, 64), (3, 4096, 2), (1, 8, 64), (4, 40, 5), (0, 4096, 64)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, radius, few, short):
    monkeypatch.setattr(sd, "SHORT", short)
    rng = random.Random(radius + few)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(90):
            x = base
            for _ in range(rng.randint(0, 6)):
                # half the members share a segment with the others
                x ^= 1 << rng.randrange(rng.choice([32, 64]))
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(_signed(x),) for x in [*prints, prints[0]]], "fp long")
    root = {x: x for x in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in sd.fingerprint_links(df, radius, few).collect():
        a, b = sorted(top(x % (1 << 64)) for x in r)
        root[b] = a
    want = _classes(prints, lambda a, b: (a ^ b).bit_count() <= radius)
    assert [top(x) for x in prints] == [prints[w] for w in want]


def test_every_pair_within_the_radius_shares_a_variant():
    for radius in range(7):
        masks = sd.variants((1 << 64) - 1, radius)
        rng = random.Random(radius)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), radius))
            assert any((x & m) == (y & m) and (x ^ y) & gone == gone for m, gone in masks)


def test_codes_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 16)], i % 3 if i % 7 else None) for i in range(60)]
    rows += [(2, rows[40][1], 1), (61, None, 1), (62, [None, *rows[0][1][1:]], 1), (63, [math.nan, *rows[0][1][1:]], 1), (64, [math.inf] * 16, None)]
    rows += [(None, rows[5][1], 2), (65, rows[6][1], 0), (65, rows[6][1], 0)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("ints", "code", "error", "l", "id")})
    coded, books = vc.vector_codes(table, parts=4, entries=6, rounds=5)

    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], n) for i, v, n in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    seeds = [min(v for j, v, _ in kept if j == i) for i in sorted({i for i, _, _ in kept if i is not None})[:6]]
    mine = [[s[4 * p : 4 * p + 4] for s in seeds] for p in range(4)]

    def assign(p, v):
        part = v[4 * p : 4 * p + 4]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(mine[p]))

    for _ in range(5):
        new = []
        for p in range(4):
            of = [assign(p, v)[1] for _, v, _ in kept]
            groups = [[v[4 * p : 4 * p + 4] for (_, v, _), k in zip(kept, of) if k == e] for e in range(6)]
            new.append([[sum(c) // len(g) for c in zip(*g)] if g else mine[p][e] for e, g in enumerate(groups)])
        mine = new
    want = [(i, [assign(p, v) for p in range(4)], n) for i, v, n in kept]
    by_label = {m: sum(d for _, a, n in want if n == m for d, _ in a) for m in {n for _, _, n in want}}
    want = [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), by_label[n]) for i, a, n in want]
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in books] == mine
    text = ",".join(str(x) for b in mine for e in b for x in e)
    assert vc.codebooks_digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_codes_of_few_or_unfit_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vc.vector_codes(spark.createDataFrame([], kind))[0].count() == 0
    few = spark.createDataFrame([(1, [0.5] * 8, None), (2, [0.5] * 8, None)], kind)
    assert sorted(tuple(r) for r in vc.vector_codes(few)[0].collect()) == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    with pytest.raises(ValueError, match="one length"):
        vc.vector_codes(spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], kind))
    with pytest.raises(Exception, match="64 bits"):
        vc.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], kind))


@pytest.mark.parametrize("entries", [1, 3, 16, 100])
@pytest.mark.parametrize("spread", [2, 1 << 26])
def test_tree_finds_the_nearest_entry(entries, spread):
    rng = np.random.default_rng(entries)
    book = rng.integers(-spread, spread, (entries, 3))
    points = np.concatenate([rng.integers(-spread, spread, (2000, 3)), book])
    d = vc.squared(points, book)
    best, error = vc.nearest_entries(vc.build(book), book, points)
    assert (best == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def _report(rows):
    """The rules of the repair, row by row."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x))
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    full = {"u": "user", "a": "assistant"}
    report = {}
    for c, own in convs.items():
        seq = []
        for t, r, x in own:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            r, x = " " if r is None else r, " " if x is None else x
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            seq += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        seq.sort(key=lambda z: ((0, 0) if z[0] is None else (1, z[0]), z[1].encode(), z[2].encode()))
        turns = {t for t, _, _ in seq if t is not None}
        faults, seen = [], set()
        for _, r, x in seq:
            bare = x.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in seq]

        def put(state, q, way):
            if q not in state or way[:2] < state[q][:2]:
                state[q] = way

        def closed(state):
            for _ in range(3):
                for (role, p), q in step.items():
                    if role != "s" and p in state:
                        cost, audit, plan = state[p]
                        put(state, q, (cost + 3, audit + "I", (*plan, f"{full[role]}:")))
            return state

        state = closed({0: (0, "", ())})
        for (_, r, x), fault, initial in zip(seq, faults, initials):
            new = {}
            for p, (cost, audit, plan) in state.items():
                put(new, p, (cost + 4, audit + "D", plan))
                for (role, p2), q in step.items():
                    if p2 == p and fault not in ("b", "d"):
                        mend = 3 * (fault == "t")
                        if role == initial:
                            put(new, q, (cost + mend, audit + "K", (*plan, f"{r}:{x}")))
                        if role != "s":
                            put(new, q, (cost + mend + 3, audit + "R", (*plan, f"{full[role]}:{x}")))
            state = closed(new)
        cost, audit, plan = min((state[q] for q in (0, 3) if q in state), key=lambda w: w[:2])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(plan).encode()).hexdigest()
        report[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, digest)
    return report


def _turns():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", "  \t", None, "what? ", "a ", "end\n", " ", "Yes.", "u:x\ny."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "umpire"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(roles[:5] if conv and conv % 2 else roles), rng.choice(texts)))
    rows += [(50, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(700)]
    return rows + rows[:20]


@pytest.mark.parametrize(("block", "fan"), [(256, 64), (3, 2)])
def test_repair_equals_the_rules(spark, monkeypatch, block, fan):
    monkeypatch.setattr(tr, "BLOCK", block)
    monkeypatch.setattr(tr, "FAN", fan)
    rows = _turns()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spoilt = tr.damaged(turns).withColumns({c: F.lit("old") for c in ("conv", "pos", "seq", "fault", "audit", "id", "block")})
    report, lines = tr.repair_conversations(spoilt, known=turns)
    assert {r[0]: tuple(r)[1:] for r in report.collect()} == _report(rows)
    for conv, part in itertools.groupby(sorted(lines.collect()), key=lambda r: r.conv):
        part = list(part)
        assert [r.at for r in part] == list(range(len(part)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in part))


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, lines = tr.repair_conversations(tr.damaged(turns), known=turns)
    assert report.count() == lines.count() == 0


def test_cells_do_not_depend_on_the_cut():
    rng = random.Random(2)
    for _ in range(100):
        codes = "".join(rng.choice(tr._CODES) for _ in range(rng.randint(2, 12)))
        for at in range(1, len(codes)):
            assert tr._joined(tr.span_cell(codes[:at]), tr.span_cell(codes[at:])) == tr.span_cell(codes)


def test_steps_belong_to_their_block(spark):
    outside = stored(spark.range(3))
    with steps(spark):
        inside = stored(spark.range(5))
        assert inside.count() == 5
    assert outside.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        inside.count()


def test_sketches_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(5)
    for size in (3, 40, 700, 3000):
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for gone, more in ((0, 0), (1, 0), (size // 5, 1), (0, size // 4)):
            y = np.concatenate([x[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
            one = np.zeros(size, dtype=np.int64)
            a, m = nj._sketches(one, x, np.array([len(x)]))
            b, n = nj._sketches(one[:1].repeat(len(y)), y, np.array([len(y)]))
            w = int(min(m[0], n[0]))
            folded = [np.bitwise_xor.reduce(s.reshape(-1, w), axis=0) for s in (a, b)]
            assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= gone + more


@pytest.mark.parametrize("paired", [512, 3])
def test_components_of_groups_of_near_copies(spark, monkeypatch, paired):
    """Chains and groups of edited copies of several lengths, against all pairs."""
    monkeypatch.setattr(nj, "PAIRED", paired)
    rng = random.Random(8)
    rows = []
    for words in (12, 60, 300, 1400):
        base = [f"g{words}w{i}" for i in range(words)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(1 + words // 40)):
                copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in rows)]
    want = _classes(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r.doc_id: r.component_id for r in nj.ngram_components(docs, gram=5, percent=80).collect()}
    assert got == dict(enumerate(want))
