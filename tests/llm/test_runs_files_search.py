"""Periodic runs, token files and bag search on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from woonvonk.llm import bag_search, bpe, common, runs, token_files
from woonvonk.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j"), (6, "x " + "la la " * 20 + "\n\n y"), (7, "naïve 日本 🙂 " * 9),
    (8, "word " * 30_000), (8, "word " * 30_000), (None, "do re mi " * 8), (None, None), (10, "A a A a " * 12), (11, "<|endoftext|> is text  here\t"),
    (3_000_000_000, "far away"),
]


def frame(spark, rows, columns=("n", "h", "g", "a", "p", "words", "bag", "m", "members", "key", "frame", "task", "row", "start", "length", "runs")):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in columns})


def brute_runs(s: list, least: int) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(s) // 2 + 1):
        x = 0
        while x < len(s) - q:
            y = x
            while y < len(s) - q and s[y] == s[y + q]:
                y += 1
            n = y - x + q
            if n >= max(least, 2 * q) and not any(all(s[x + i] == s[x + i + p] for i in range(n - p)) for p in range(1, q)):
                found.append((x, n, q))
            x = max(y, x + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


pieces = st.lists(st.integers(0, 2), min_size=1, max_size=9).flatmap(lambda u: st.integers(1, 6).map(lambda k: u * k))


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=5).map(lambda x: [w for part in x for w in part]), st.sampled_from([2, 5, 12]))
def test_runs_equal_brute_force(words, least):
    assert [tuple(r) for r in runs.runs_of(np.array(words, np.int64), least).tolist()] == brute_runs(words, least)


def test_runs_at_a_place_where_two_stretches_of_one_period_meet():
    words = [0, 1] * 10 + [0] + [0, 1] * 10 + [0]
    found = [tuple(r) for r in runs.runs_of(np.array(words), 2).tolist()]
    assert found == brute_runs(words, 2) and {q for _, _, q in found} >= {1, 2, 3, 5, 7}


def test_runs_of_a_long_text():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 10**9, 200_000)
    own[50_000:90_000] = np.resize(own[50_000:50_777], 40_000)
    assert (50_000, 40_000, 777) in [tuple(r) for r in runs.runs_of(own).tolist()]


def by_hand(doc_id, text, plant):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words, 12) if n < 2000 else [(0, n, 1)]
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    text = "".join(f"{s},{n_},{q}\n" for s, n_, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest(text), digest(kept))


def test_run_query_equals_brute_force(spark):
    rng = random.Random(4)
    rows = TEXTS + [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 80)))) for i in range(120)]
    got = runs.digest(runs.find_runs(runs.planted(frame(spark, rows))))
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(i, t, True) for i, t in rows)
    plain = runs.digest(runs.find_runs(frame(spark, rows)))
    assert Counter(map(tuple, plain.collect())) == Counter(by_hand(i, t, False) for i, t in rows)
    assert runs.digest(runs.find_runs(runs.planted(frame(spark, [])))).count() == 0


def test_runs_do_not_depend_on_how_texts_are_grouped(spark, monkeypatch):
    texts = [t for _, t in TEXTS if t and len(t) < 1000] * 3
    words = [t.encode().split() for t in texts]
    ids = pa.array(range(len(texts)))
    whole = runs._found(ids, words, 12).to_pylist()
    each = [runs._found(ids.slice(i, 1), words[i : i + 1], 12).to_pylist()[0] for i in range(len(words))]
    assert whole == each
    monkeypatch.setattr(runs, "GROUP_WORDS", 50)
    groups = list(runs._groups([len(w) for w in words]))
    assert [i for a, b in groups for i in range(a, b)] == list(range(len(words)))


def test_token_files_round_trip(spark):
    rng = random.Random(5)
    rows = TEXTS + [(50 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 300)))) for i in range(80)]
    files = token_files.write(frame(spark, rows).repartition(3), scratch_path(spark, "token-files"), file_docs=3)
    assert files.dictionary and files.manifest.count() > 4
    library = Tokenizer.from_file(bpe.VOCABULARY)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, token_files.END]
    got = token_files.read(files).orderBy("start").collect()
    key = lambda i: (i is not None, i or 0)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=key)
    start, left = 0, defaultdict(Counter)
    for i, t in rows:
        left[i][tuple(ids(t))] += 1
    for r in got:
        found = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert (r.start, r.n_tokens) == (start, len(found)) and left[r.doc_id][found] > 0
        left[r.doc_id][found] -= 1
        start += len(found)
    # one document at a time, by the index
    wanted = spark.createDataFrame([(8,), (11,), (60,), (999,)], "doc_id long")
    some = Counter((r.doc_id, r.start, bytes(r.ids)) for r in token_files.fetch(files, wanted).collect())
    assert some == Counter((r.doc_id, r.start, bytes(r.ids)) for r in got if r.doc_id in (8, 11, 60))
    assert token_files.index(files).count() == len(rows)


def test_token_files_refuse_another_dictionary(spark):
    files = token_files.write(frame(spark, [(1, "a")]), scratch_path(spark, "token-files"))
    assert files.dictionary == b""  # too little to train on
    path = files.manifest.first().file
    reader = token_files.FileReader(path, b"")
    assert [(i, n) for i, n, _ in reader.documents()] == [(1, 0)]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.FileReader(path, b"other")
    empty = token_files.write(frame(spark, []), scratch_path(spark, "token-files"))
    assert token_files.read(empty).count() == 0 and token_files.index(empty).count() == 0


def test_trained_dictionary_makes_short_documents_smaller():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 50_000, 4).astype("<u2").tobytes() for _ in range(400)]
    samples = [b"".join(words[i] for i in rng.zipf(1.3, 40) % 400) for _ in range(1500)]
    dictionary = token_files.trained(samples)
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(s)) for s in samples[:200])
    press = zstandard.ZstdCompressor(level=3, dict_data=token_files._prepared(dictionary)).compress
    assert sum(len(press(s)) for s in samples[:200]) < 0.7 * plain


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    fold = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(fold(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, bag), n in zip(bags, sizes):
            score = 0
            for t in fold(text):
                if bag[t]:
                    m = 100 - 75 + 75 * n * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "it's", "a-b"]
    made = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.7)) - 1, 43)].upper() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(n))
    docs = TEXTS + [(100 + i, made(rng.randint(0, 40))) for i in range(300)] + [(1000 + i, "same Words; same words") for i in range(60)]
    docs += [(2000 + i, f"same words ... {'!' * i}same words") for i in range(20)]  # other texts, same class
    items = [(i, made(rng.randint(1, 12))) for i in range(30)] + [(30, None), (31, ""), (32, "same words"), (32, "same words"), (None, "la word"), (33, "?!"), (34, "nowhere1")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    expected = brute_search(docs, items, 10)
    assert Counter(map(tuple, bag_search.search(frame(spark, docs).repartition(5), asked).collect())) == expected
    monkeypatch.setattr(bag_search, "BLOCK_BYTES", 300)  # several blocks
    monkeypatch.setattr(bag_search, "CELLS", 2000)
    assert Counter(map(tuple, bag_search.search(frame(spark, docs), asked).collect())) == expected
    assert Counter(map(tuple, bag_search.search(frame(spark, docs), asked, 3).collect())) == brute_search(docs, items, 3)
    assert bag_search.search(frame(spark, []), asked).count() == 0
    assert bag_search.search(frame(spark, docs), asked.limit(0)).count() == 0


def test_equal_bags_are_one_class(spark):
    docs = [(i, "x y x") for i in range(40)] + [(100 + i, "y, x... x?") for i in range(5)] + [(200, "x y"), (201, "x y x z")]
    bagged = bag_search.bags(frame(spark, docs), {b"x": 0, b"y": 1})
    got = bag_search.classes(bagged, 47, 141, 10).collect()
    assert sorted((r.m, r.members) for r in got) == [(75, list(range(10))), (75, [200])] or len(got) == 3
    assert max(len(r.members) for r in got) == 10


def test_whole_batches_encode_like_texts_one_by_one():
    own = bpe.Codec(bpe.model_settings(bpe.VOCABULARY))
    texts = [t for _, t in TEXTS] + ["a  b", "tail ", " lead", "don't, won't.", "x y", "word, word. word,", "a\n b", "a \nb", "ſtraße, ǅ."]
    library = Tokenizer.from_file(bpe.VOCABULARY)
    got = []
    for first, ids, ends in own.encode_all(pa.array(texts, pa.string())):
        assert first == len(got)
        got += [r.tolist() for r in np.split(ids, ends[:-1])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(own.encode_all(pa.array([], pa.string()))) == []


def test_a_worker_keeps_one_thing_at_a_time():
    a = common.kept_in_worker("one", list)
    assert common.kept_in_worker("one", list) is a
    common.kept_in_worker("two", dict)
    assert common.kept_in_worker("one", list) is not a and list(common._KEPT) == ["one"]
