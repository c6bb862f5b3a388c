"""Byte-level BPE: texts to token ids over Arrow batches, with offsets, and back.

Bytes are mapped to printable characters, each pre-token is merged by the tokenizers library's BPE model, and decoding
reverses the byte table; characters whose bytes are split over tokens come back whole. Words repeat, so ids are made once
per distinct word of a slice of texts, and a worker keeps those it has met, in tables of bounded size that go when another
operator's tasks start. A text is first cut at single blanks between other characters, where no match of the pattern can
cross; texts with any other white space next to a blank take the pattern as a whole. Both ways give the same ids.

Null texts count as empty and give no ids. Other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from woonvonk.llm.common import kept_in_worker, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Entries of words a worker keeps in each of two generations, and the longest word kept: some 100 MB at most.
KEPT = 250_000
KEPT_CHARS = 40
# Bytes of text that are worked on at a time.
SLICE_BYTES = 8 << 20

# Texts with white space other than single blanks and line feeds inside the text, in RE2's notation.
ODD_SPACE = (
    r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|\A[ \n]|[ \n]\z| [ \n]|\n "
)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table_, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table_:
            table_[b] = chr(256 + extra)
            extra += 1
    return [table_[b] for b in range(256)]


CHARACTERS = byte_characters()
TO_CHARACTERS = dict(enumerate(CHARACTERS))
BLANK = CHARACTERS[0x20]
TO_BYTES = {c: b for b, c in TO_CHARACTERS.items()}


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARACTERS)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts that the ranks below a token's own leave of it, in rank order."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            scores = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            best = min(scores)
            if best >= rank:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


def model_settings(path: str) -> str:
    """Vocabulary and merges as JSON, from a rank file or from a tokenizers file; a few MB whatever the corpus.

    A tokenizers file also gives its added tokens, which texts are split at first; a rank file has none.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        if (whole.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or whole.get("normalizer"):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        added = whole.get("added_tokens") or []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError(f"added tokens that take in what is around them: {path}")
        return json.dumps({"vocab": whole["model"]["vocab"], "merges": merges, "added": {t["content"]: t["id"] for t in added}})
    ranks = ranks_of(path)
    merges = [(to_characters(a), to_characters(b)) for a, b in merges_of(ranks)]
    return json.dumps({"vocab": {to_characters(t): r for t, r in ranks.items()}, "merges": merges})


def largest_id(settings: str) -> int:
    given = json.loads(settings)
    return max([*given["vocab"].values(), *(given.get("added") or {}).values()])


class _Kept:
    """Ids, as little-endian unsigned 32-bit bytes, of what was met before; the older generation goes when the newer is full."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def __getitem__(self, key: str) -> bytes:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(key) <= KEPT_CHARS:
                if len(self.new) >= KEPT:
                    self.old, self.new = self.new, {}
                self.new[key] = found
        return found


class Codec:
    def __init__(self, settings: str, pattern: str = public_tokenizers.PATTERN):
        given = json.loads(settings)
        self.model = BPE(vocab=given["vocab"], merges=[tuple(m) for m in given["merges"]], cache_capacity=0)
        self.find = regex.compile(pattern).findall
        self.pieces = _Kept(self._piece)
        self.chunks = _Kept(self._chunk)
        self.letters_match = pattern == public_tokenizers.PATTERN
        self.marks = {m: self._piece(m) for m in ",."}
        self.added = given.get("added") or {}
        self.split_added = regex.compile(f"({'|'.join(map(regex.escape, sorted(self.added, key=len, reverse=True)))})").split
        size = largest_id(settings) + 1
        self.bytes_of = [b""] * size
        for token, i in given["vocab"].items():
            if all(c in TO_BYTES for c in token):
                self.bytes_of[i] = bytes(TO_BYTES[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.digits = [str(i) for i in range(size)]

    def _ids(self, characters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(characters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._ids(to_characters(piece.encode()))

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a word behind a blank; letters are one match of the pattern, and so are a comma or stop after them."""
        if self.letters_match:
            if chunk.isalpha():
                return self._ids(BLANK + chunk) if chunk.isascii() else self._piece(" " + chunk)
            if chunk[-1:] in self.marks and chunk[:-1].isalpha():
                return self.chunks[chunk[:-1]] + self.marks[chunk[-1]]
        return b"".join([self._piece(p) for p in self.find(" " + chunk)])

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        for token in self.added:
            if token in text:
                # every second part is an added token
                return b"".join([array("I", [self.added[x]]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(self.split_added(text))])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.find(text)])

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ids of all texts (null: empty), slice by slice: (first row, ids, where each row's ids end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield start, *self._slice(texts.slice(start, stop - start))
            start = stop

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        slow = pc.match_substring_regex(texts, ODD_SPACE)
        for token in self.added:
            slow = pc.or_(slow, pc.match_substring(texts, token))
        odd = np.flatnonzero(slow.to_numpy(zero_copy_only=False))
        ids, ends = self._words(pc.if_else(slow, "", texts) if len(odd) else texts)
        if len(odd):
            rows = np.split(ids, ends[:-1])
            for i in odd.tolist():
                rows[i] = np.frombuffer(self.encode(texts[i].as_py()), "<u4")
            ids, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
        return ids, ends

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids by way of the distinct words between blanks; the first word of a text has no blank before it."""
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy()
        bounds = bounds - bounds[0]
        words = parts.flatten()
        first, more = bounds[:-1], words.dictionary_encode()
        leads = words.take(pa.array(first)).dictionary_encode()
        code = more.indices.to_numpy().astype(np.int64)
        code[first] = len(more.dictionary) + leads.indices.to_numpy()
        used = np.bincount(code, minlength=len(more.dictionary) + len(leads.dictionary))
        made = [self.chunks[w] if n else b"" for w, n in zip(more.dictionary.to_numpy(zero_copy_only=False), used.tolist())]
        made += [self._plain(w) for w in leads.dictionary.to_numpy(zero_copy_only=False)]
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        begin = np.cumsum(size) - size
        each = size[code]
        ends = np.cumsum(each)
        at = np.repeat(begin[code] - ends + each, each) + np.arange(ends[-1])
        return np.frombuffer(b"".join(made), "<u4")[at], ends[bounds[1:] - 1]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Per token the code points it covers, end exclusive; a token inside a character covers that character."""
        spans, at = [], 0
        starts = np.fromiter((len(c.encode()) for c in text), np.int64, len(text)).cumsum() if text else np.zeros(0)
        for i in np.frombuffer(self.encode(text), "<u4").tolist():
            size = len(self.bytes_of[i])
            first = int(np.searchsorted(starts, at, side="right"))
            last = int(np.searchsorted(starts, at + size - 1, side="right"))
            spans.append((first, last + 1))
            at += size
        return spans

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text each token completes: bytes of a split character wait for the rest of it."""
        waiting = b""
        for i in ids:
            waiting += self.bytes_of[i]
            cut = len(waiting)
            for back in range(1, min(4, len(waiting)) + 1):
                lead = waiting[-back]
                if lead >= 0xC0:
                    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    cut = len(waiting) - back if back < need else cut
                    break
                if lead < 0x80:
                    break
            yield waiting[:cut].decode("utf-8", "replace")
            waiting = waiting[cut:]
        if waiting:
            yield waiting.decode("utf-8", "replace")


def codec(settings: str) -> Codec:
    """One codec per worker process; its tables live on from task to task until another operator's tasks come."""
    return kept_in_worker(("codec", hash(settings)), lambda: Codec(settings))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""


def encode(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``offsets`` array<struct<start, end>> in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model_settings(path))

    @F.pandas_udf("struct<ids:array<int>,offsets:array<struct<start:int,end:int>>>")
    def run(texts):
        import pandas as pd

        own = codec(shared.value)
        rows = [x or "" for x in texts]
        return pd.DataFrame(
            {
                "ids": [np.frombuffer(own.encode(x), "<u4").astype("i4") for x in rows],
                "offsets": [[{"start": a, "end": b} for a, b in own.offsets(x)] for x in rows],
            }
        )

    out = docs.withColumn("__encoded", run(F.col(text)))
    return out.select(*docs.columns, "__encoded.ids", "__encoded.offsets")


def decode(docs: DataFrame, ids: str = "ids", path: str = RANKS) -> DataFrame:
    """``docs`` with ``decoded`` binary, the bytes of ``ids``; null ids give empty bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model_settings(path))

    @F.pandas_udf("binary")
    def run(rows):
        own = codec(shared.value)
        return rows.map(lambda x: own.decode([] if x is None else x))

    return docs.withColumn("decoded", run(F.col(ids)))


def digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): token count, digest of the ids, digest of what the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(model_settings(path))

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            counts, ids_hex, back_hex = [], [], []
            for _, ids, ends in own.encode_all(batch.column(1)):
                all_ids, at = ids.tolist(), 0
                for end in ends.tolist():
                    row, at = all_ids[at:end], end
                    counts.append(len(row))
                    ids_hex.append(hashlib.sha256(" ".join([own.digits[i] for i in row]).encode()).hexdigest())
                    back_hex.append(hashlib.sha256(own.decode(row)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(back_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
