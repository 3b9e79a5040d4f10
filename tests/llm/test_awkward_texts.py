"""Tokens of all characters, very long texts with hits, and columns that meet an operator's own names."""

import hashlib
import os
import random
import time
import unicodedata

import numpy as np
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from lodestone.llm import bpe, line_dedup as ld, queries, secret_scan as ss, simhash as sh, winnowing as wn  # noqa: E402
from lodestone.llm.packing import text_ids  # noqa: E402

CHARS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
MARKS = [chr(c) for c in CHARS if unicodedata.combining(chr(c))]


def differing(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKENIZER)
    want = (e.ids for e in library.encode_batch(texts, add_special_tokens=False))
    return [ascii(t) for t, w, g in zip(texts, want, text_ids(texts, queries.TOKENIZER), strict=True) if w != g.tolist()]


def test_tokens_of_every_character_equal_the_library():
    assert not differing([" ".join(f"a{chr(c)}b" for c in CHARS[i : i + 256]) for i in range(0, len(CHARS), 256)])


def test_tokens_of_marks_and_mixed_texts_equal_the_library():
    draw = random.Random(3)
    assert not differing([f"e{m}{draw.choice(MARKS)}{draw.choice(MARKS)}x" for m in MARKS for _ in range(6)])
    pool = MARKS + [chr(draw.choice(CHARS)) for _ in range(3000)] + list("abc ABC'12.ΣσİK\n  ") * 60 + ["'ll", "don't ", "<|endoftext|>"] * 30
    assert not differing(["".join(draw.choices(pool, k=draw.randrange(40))) for _ in range(20_000)])
    kinds, foreign = bpe._classes()
    assert not foreign[: 0x300].any() and kinds[0x1C89] == bpe.OTHER and foreign[0x1C89]


def test_long_texts_take_time_in_proportion(spark):
    text = "\n".join(f"line {i}" for i in range(200_000))
    table = spark.createDataFrame([(1, text), (2, text), (3, f"new\n{text}\nend")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(table).collect()}
    only = {r.doc_id: r.text for r in ld.dedup_lines(table).select("doc_id", "text").collect()}
    assert got == {1: (text, 200_000, 0), 2: ("", 200_000, 200_000), 3: ("new\nend", 200_002, 200_000)}
    assert only == {i: t for i, (t, _, _) in got.items()}
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(100_000)]
    found = ss.spans_of(" ".join(keys))
    assert [(k, s, e) for k, s, e, _, _ in found] == [(2, 33 * i, 33 * i + 32) for i in range(len(keys))]
    assert time.perf_counter() - start < 90


def test_known_spans_cover_strings_as_a_plain_search_says():
    draw = random.Random(5)
    parts = ["token=", "AKIA", "password: ", " ", "/", "-", "\n"]
    for _ in range(300):
        text = "".join(draw.choice(parts) + "".join(draw.choices("abcdef0123456789ABCXYZ", k=draw.randrange(45))) for _ in range(12))
        out = ss.spans_of(text)
        known = [(s, e) for k, s, e, _, _ in out if k < 3]
        tested = {(m.start() + s, m.start() + e) for m in ss._STRING.finditer(text) for s, e, _ in ss._tested(m[0], ss.DOUBT)
                  if not any(a <= m.start() and m.end() <= b for a, b in known)}
        assert {(s, e) for k, s, e, _, _ in out if k == 3} == {(s, e) for s, e in tested if not any(a <= s and e <= b for a, b in known)}


def test_columns_with_the_names_of_steps_are_kept(spark):
    names = ["_key", "_id", "_lines", "_gone", "_kept", "_at", "_plain", "_no_id", "_words", "_terms", "_n", "_chunks", "_range", "_p",
             "kinds", "starts", "ends", "bands", "steps", "span_starts", "span_ends", "kept0"]
    rows = [(1, "a b c d e f g h i j k"), (2, None), (3, "x\ny\nz"), (4, "x\ny\nz"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(i) for i, n in enumerate(names)})
    items = spark.createDataFrame([("i", "a b c d e f g h i j"), ("k", "p q " * 40), ("l", "x y z")], "item_id string, text string")
    results = [
        ld.dedup_lines(docs),
        ss.find_secrets(docs),
        wn.flag_contaminated(docs, items),
        wn.flag_contaminated(docs, items, block_bytes=64),
        sh.fingerprints(docs),
        sh.with_next(docs, "doc_id", "text", []),
    ]
    for df in results:
        found = df.select(*names).collect()
        assert len(found) == len(rows) and all(list(r) == list(range(len(names))) for r in found)
    one, many = ({r.doc_id: (r.n_hit, r.item_ids) for r in results[i].collect()} for i in (2, 3))
    assert one == many and one[1] == (10, ["i"]) and one[3] == (3, ["l"])
    ahead = {r.doc_id: r.next_text for r in results[5].collect()}
    assert ahead == {4: rows[2][1], 3: None, 2: rows[0][1], 1: "", None: rows[3][1]}
    assert np.array_equal(sorted(r.n_removed for r in results[0].collect()), [0, 0, 0, 0, 3])
