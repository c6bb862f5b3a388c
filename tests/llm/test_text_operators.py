"""BPE, packing, line dedup, n-gram join and quality rules on small tables with nulls, empty and long texts, and ties."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from woonvonk.llm import bpe, line_dedup, ngram_join, packing, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG_LINE = "this very long line stands in many documents of the corpus"


def frame(spark, rows, extra=True):
    """(doc_id, text) with columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in ("n", "key", "d", "length", "n_lines", "failed_bits", "rep", "lang")}) if extra else df


TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j"), (6, "A B  C\nd e f g h i J"), (7, "naïve 日本 🙂 it's 12³ \r\n\n x "),
    (8, "word " * 30_000), (8, "word " * 30_000), (9, "\n".join([LONG_LINE] * 3 + ["short", "  " + LONG_LINE.upper() + "\t"])),
    *[(10 + i, f"{LONG_LINE}\nown line number {i} of this document") for i in range(6)], (None, "no id " + LONG_LINE), (17, "#a $b %c d|e <f> &g *h 1 2 3"),
]


def test_bpe_equals_the_rank_library(spark):
    ranks = bpe.ranks_of(bpe.RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(frame(spark, TEXTS)).collect()}
    assert len(got) == len({i for i, _ in TEXTS})
    for doc_id, text in TEXTS:
        ids = own.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(frame(spark, [])).count() == 0


def test_bpe_edges_and_offsets(spark):
    ranks = bpe.ranks_of(bpe.RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Codec(bpe.model_settings(bpe.RANKS))
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t\r  ab'sS1²é日🙂.!#\x1c\x85 ") for _ in range(rng.randint(0, 14)))
        ids = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert ids == own.encode_ordinary(text)
        assert mine.decode(ids).decode() == text and "".join(mine.decode_stream(ids)) == text
        spans = mine.offsets(text)
        assert len(spans) == len(ids) and all(a < b <= len(text) for a, b in spans)
        for (a, b), i in zip(spans, ids):
            assert mine.bytes_of[i] in text[a:b].encode()
    out = bpe.decode(bpe.encode(frame(spark, TEXTS[:7]))).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in out)


def test_packing_is_whole_gapless_and_best_fit(spark):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    library.encode_special_tokens = True
    got = packing.pack(frame(spark, TEXTS)).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    lengths = []
    for doc_id, text in dict(TEXTS).items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        copies = sum(i == doc_id for i, _ in TEXTS)
        mine = Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id])
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
        assert mine == Counter({w: copies for w in want}) and sum(w[2] for w in want) == len(ids)
        lengths += [w[2] for w in want] * copies
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == best_fit(lengths, 2048)
    assert packing.pack(frame(spark, [])).count() == 0


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_uses_as_many_bins_as_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([7, 10, 33, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        counts, steps = Counter(lengths), packing.plan(dict(Counter(lengths)), capacity)
        bins = defaultdict(list)
        for n, c in counts.items():
            mine = steps[steps[:, 0] == n]
            for rank in range(c):
                at = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
                bins[at[2] + (rank - at[1]) // at[3]].append((at[4] + (rank - at[1]) % at[3] * n, n))
        assert len(bins) == best_fit(lengths, capacity)
        for held in bins.values():
            assert all(o == sum(n for p, n in held if p < o) for o, _ in held) and sum(n for _, n in held) <= capacity


def expected_lines(rows):
    docs = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and doc_id is not None:
                docs[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(docs[key(x)]) < 5 or doc_id == max(docs[key(x)])]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def lines_of(df):
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()], key=repr)


def test_line_dedup_equals_brute_force_and_can_be_taken_back(spark):
    docs = frame(spark, TEXTS)
    index = line_dedup.build(docs)
    out = line_dedup.apply(index, docs, index.postings)
    assert lines_of(out) == expected_lines(TEXTS) and out.where("lang = 'lang' AND key = 'key'").count() == len(TEXTS)
    more = [(100, LONG_LINE), (101, "another line that five documents are going to share soon")] + [
        (102 + i, "another line that five documents are going to share soon") for i in range(4)
    ]
    new = frame(spark, more)
    grown = line_dedup.insert(index, new)
    assert lines_of(line_dedup.apply(grown, frame(spark, TEXTS + more))) == expected_lines(TEXTS + more)
    back = line_dedup.delete(grown, new)
    assert lines_of(line_dedup.apply(back, docs)) == expected_lines(TEXTS)
    few = line_dedup.delete(back, frame(spark, [(15, None), (14, None), (13, None), (12, None)]))
    rest = [x for x in TEXTS if x[0] not in (12, 13, 14, 15)]
    assert lines_of(line_dedup.apply(few, frame(spark, rest))) == expected_lines(rest)
    empty = frame(spark, [])
    assert line_dedup.apply(line_dedup.build(empty), empty).count() == 0


def test_cuckoo_filter():
    rng = np.random.RandomState(4)
    k1, k2 = (rng.randint(-(2**63), 2**63, 5000, dtype=np.int64) for _ in range(2))
    made = line_dedup.CuckooFilter.of(k1, k2)
    assert made.has(k1, k2).all()
    made.delete(k1[:2000], k2[:2000])
    assert made.has(k1[2000:], k2[2000:]).all() and made.has(k1[:2000], k2[:2000]).mean() < 0.02
    again = line_dedup.CuckooFilter(data=made.data())
    assert again.insert(k1[:2000], k2[:2000]) and again.has(k1, k2).all()


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def expected_groups(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted([(i, len(shingles(t)), None if i is None else root(i)) for i, t in rows], key=repr)


def family(rng, size, words, edits, first_id):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for k in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        rows.append((first_id + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("column, difference", [(16_384, 1 << 20), (64, 256), (9, 9)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, column, difference):
    """Also with columns so small that near copies go through several levels of differences, and through the last resort."""
    monkeypatch.setattr(ngram_join, "COLUMN_PAIRS", column)
    monkeypatch.setattr(ngram_join, "DIFFERENCE_PAIRS", difference)
    monkeypatch.setattr(ngram_join, "OFTEN", 4)
    monkeypatch.setattr(ngram_join, "LEVELS", 6 if difference > 9 else 1)
    rng = random.Random(5)
    boiler = " ".join(f"b{i}" for i in range(40))
    rows = [x for x in TEXTS if x[0] != 8] + family(rng, 60, 60, 5, 1000) + family(rng, 25, 150, 12, 2000) + family(rng, 30, 12, 1, 3000)
    rows += [(4000 + i, boiler + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 60])))) for i in range(30)]
    rows += [(5000 + i, "the same short text") for i in range(20)]
    got = sorted([tuple(r) for r in ngram_join.grouped(frame(spark, rows)).collect()], key=repr)
    assert got == expected_groups(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.grouped(frame(spark, [])).count() == 0
    got = ngram_join.grouped(frame(spark, [(1, None), (2, " "), (2, " ")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def measured(text):
    words, t = WORD.findall(text or ""), text or ""
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    rows = TEXTS + [(50 + i, " ".join(rng.choice("abc") + rng.choice(["", "\n", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs = frame(spark, rows).withColumns({"n_words": F.lit("clash"), "__t": F.lit("clash")}).drop("__t")
    out = rules.ledger(docs)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == Counter((i, *measured(t)) for i, t in rows)
    few = out.where(F.col("failed_bits").bitwiseAND(1) != 0).count()
    assert few == sum(measured(t)[0] < 10 for _, t in rows)
    # leaving a rule out brings back what only it rejects
    for policy, names in rules.POLICIES.items():
        kept = out.where(rules.judged(out, policy)).count()
        only = {r.rule: r.n_only for r in rules.ablation(out, policy).collect()}
        for name in names:
            bit = 1 << list(rules.RULES).index(name)
            without = out.where(F.col("failed_bits").bitwiseAND(rules.mask(policy) & ~bit) == 0).count()
            assert without - kept == only.get(name, 0)
    assert rules.ledger(frame(spark, [])).count() == 0


def test_packing_has_the_ids_of_added_tokens(spark):
    """Texts that hold the string of an added token get the tokenizers library's ids; ranks without such tokens don't."""
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  c", "<|endoftext|", " x <|endoftext|>\n", "none"]
    library = Tokenizer.from_file(bpe.VOCABULARY)
    got = {r.doc_id: r for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    own = bpe.Codec(bpe.model_settings(bpe.VOCABULARY))
    for k, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids and own.decode(ids).decode() == text
        assert (got[k].length, got[k].ids_crc32) == (len(ids) + 1, zlib.crc32(np.array([*ids, packing.END], "<u4").tobytes()))
    assert 50256 not in np.frombuffer(bpe.Codec(bpe.model_settings(bpe.RANKS)).encode(texts[0]), "<u4")
