"""Byte-level BPE by speculation and verification.

Encoding: texts are cut at special tokens and by the byte-level pattern into words. For the distinct words that a worker has
not met lately, greedy longest match proposes tokens; a vectorised check then asks of every adjacent pair whether undoing the
two tokens' own merges ever uncovers a merge across their border that would have come first. If no pair of a word does, the
proposal is the encoding; the failing words alone are merged exactly, rank by rank. Decoding gathers token bytes.

A worker keeps two generations of about ``CACHE_WORDS`` encoded words, and works on ``BLOCK_BYTES`` of text at a time; a longer text is a
block of its own and is never cut. No shuffle takes place.

Defined cases: null and empty texts encode to an empty list, an empty list or null decodes to the empty text; bytes that are
no UTF-8 when tokens are joined become U+FFFD; ids outside the vocabulary raise; rows are handled one by one and every
other column is kept.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import small_batches

CACHE_WORDS = 300_000
BLOCK_BYTES = 1 << 20
_NEVER = np.int64(1) << 40
#: The byte-level pattern; white space is written out, since libraries differ on U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return dict(sorted([*((chr(b), b) for b in printable), *((chr(0x100 + i), b) for i, b in enumerate(others))], key=lambda x: x[1]))


class Lookup:
    """A hash table from distinct non-negative 64-bit keys to values that answers whole arrays; -1 if absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = int(4 * max(len(keys), 1)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last one stays
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        out[found != keys] = -1
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            found, wanted = self.keys[at], keys[open_]
            hit = found == wanted
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more]
        return out


class Vocabulary:
    """Tables of one byte-level BPE vocabulary. Inside, a token's number is its rank: bytes first, then merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank = {letter: b for letter, b in letters.items()}
        left, right = list(range(256)), list(range(256))
        pairs = {}
        for a, b in merges:
            pairs[rank[a], rank[b]] = len(left)
            if a + b in rank:
                raise ValueError("two merges make the same token")
            rank[a + b] = len(left)
            left.append(rank[a])
            right.append(rank[b])
        self.pairs = pairs
        self.left, self.right = np.array(left), np.array(right)
        self.size = len(left)
        self.pair_rank = Lookup(np.array([a * self.size + b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int64))
        self.id_of_rank = np.array([vocab[t] for t in rank], np.int32)
        text = [bytes(letters[c] for c in t) for t in rank]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = dict(zip(self.id_of_rank.tolist(), text, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        top = max(by_id) + 1
        lengths = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
        self.known = np.array([i in by_id for i in range(top)])
        self.bytes_at = np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._trie(text)

    def _trie(self, text: list[bytes]) -> None:
        """Transitions (node * 256 + byte -> node) over the tokens that exact merging makes of their own bytes."""
        whole = [t for t in range(self.size)]
        own = self.merge([text[t] for t in whole])
        node_of, ends = {b"": 0}, {}
        for t, got in zip(whole, own, strict=True):
            if len(got) == 4:
                for i in range(1, len(text[t]) + 1):
                    node_of.setdefault(text[t][:i], len(node_of))
                ends[node_of[text[t]]] = t
        self.step = Lookup(np.array([node_of[p[:-1]] * 256 + p[-1] for p in node_of if p], np.int64), np.array([n for p, n in node_of.items() if p], np.int64))
        self.token_at = np.full(len(node_of), -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or _NEVER."""
        rank = self.pair_rank(a * self.size + b)
        return np.where(rank >= 0, rank, _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay apart when their bytes are merged together.

        The two tokens are taken apart again from their border, latest merge first. ``limit`` is the rank of the merge just
        undone: a border merge of a lower rank would have happened before it.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER)
        while len(live):
            clash = self.rank_of(a, b) < limit
            ok[live[clash]] = False
            rest = ~clash & ((a >= 256) | (b >= 256))  # two single bytes: nothing left to undo
            live, a, b, limit = live[rest], a[rest], b[rest], limit[rest]
            undo_a = a > b  # the later merge of the two is undone first; of equal ones the right one
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, one after the other, and each word's offsets into them."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        end_of = np.repeat(ends, lengths)
        n = len(data)
        best, size = np.full(n, -1), np.ones(n, np.int64)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            node = self.step(node * 256 + data[at + depth])
            hit = node >= 0
            at, node = at[hit], node[hit]
            depth += 1
            token = self.token_at[node]
            full = token >= 0
            best[at[full]] = token[full]
            size[at[full]] = depth
            more = at + depth < end_of[at]
            at, node = at[more], node[more]
        chosen = np.zeros(n, bool)
        at, stop = ends - lengths, ends
        while len(at) > 64:
            chosen[at] = True
            at = at + size[at]
            live = at < stop
            at, stop = at[live], stop[live]
        for p, e in zip(at.tolist(), stop.tolist(), strict=True):
            while p < e:
                chosen[p] = True
                p += int(size[p])
        picked = np.flatnonzero(chosen)
        return best[picked], np.append(np.searchsorted(picked, ends - lengths), len(picked))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Exact encodings, as ids: in every word the leftmost pair of the lowest rank is merged, again and again."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= 256]
        for i in set(range(len(words))) - set(short):
            out[i] = self.id_of_rank[self._merge_long(words[i])].tobytes()
        if not short:
            return out
        tokens = np.frombuffer(b"".join(words[i] for i in short), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        while len(tokens):
            ranks = np.full(len(tokens), _NEVER)
            ranks[:-1] = np.where(owner[:-1] == owner[1:], self.rank_of(tokens[:-1], tokens[1:]), _NEVER)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(ranks, starts)
            done = np.repeat(least == _NEVER, np.diff(np.append(starts, len(tokens))))
            if done.any():
                first = np.flatnonzero(np.diff(owner[done], prepend=-1))
                ids = self.id_of_rank[tokens[done]].tobytes()
                for o, a, b in zip(owner[done][first].tolist(), first.tolist(), [*first[1:].tolist(), len(ids) // 4], strict=True):
                    out[short[o]] = ids[4 * a : 4 * b]
            mine = np.repeat(least, np.diff(np.append(starts, len(tokens))))
            hit = np.flatnonzero((ranks == mine) & ~done)
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]  # the leftmost of each word
            tokens[hit] = ranks[hit]
            keep = ~done
            keep[hit + 1] = False
            tokens, owner = tokens[keep], owner[keep]
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one long word, with a heap over a linked list."""
        tokens = list(word)
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := self.pairs.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.pairs.get((tokens[x], tokens[y]))) is not None:
                    heapq.heappush(heap, (s, x, tokens[x], tokens[y]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers."""
        tokens, at = self.propose(words)
        inner = np.ones(len(tokens), bool)
        inner[at[1:-1] - 1] = False
        inner[-1] = False
        left = np.flatnonzero(inner)
        pairs = tokens[left] * self.size + tokens[left + 1]
        distinct, back = np.unique(pairs, return_inverse=True)
        bad = left[~self.compatible(distinct // self.size, distinct % self.size)[back]]
        failing = np.unique(np.searchsorted(at, bad, side="right") - 1)
        ids = self.id_of_rank[tokens].tobytes()
        out = [ids[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if len(failing):
            for i, exact in zip(failing.tolist(), self.merge([words[i] for i in failing]), strict=True):
                out[i] = exact
        return out


class WordCache:
    """Encodings of words met lately, in two generations of at most ``limit`` words (or one block's) each."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.special = {s: np.int32(i).tobytes() for s, i in vocabulary.special.items()}
        self.now, self.before = dict(self.special), {}

    def prepare(self, texts: list[list[str]], limit: int) -> dict[str, bytes]:
        """A table that holds the words of all texts."""
        if len(self.now) > limit:
            self.now, self.before = dict(self.special), self.now
        missing = set().union(*texts).difference(self.now)
        known = missing & self.before.keys()
        self.now.update({w: self.before[w] for w in known})
        if new := list(missing - known):
            self.now.update(zip(new, self.vocabulary.encode_words([w.encode() for w in new]), strict=True))
        return self.now


@lru_cache(maxsize=4)
def _worker_state(path: str) -> tuple[Vocabulary, WordCache]:
    vocabulary = Vocabulary(path)
    return vocabulary, WordCache(vocabulary)


def _encode(texts: pa.Array, path: str, cache_words: int) -> pa.Array:
    vocabulary, cache = _worker_state(path)
    parts: list[bytes] = []
    waiting: list[list[str]] = []
    size = 0

    def flush() -> None:
        table = cache.prepare(waiting, cache_words)
        parts.extend(b"".join(map(table.__getitem__, words)) for words in waiting)
        waiting.clear()

    for text in texts:
        text = text.as_py() or ""
        if vocabulary.cut and any(s in text for s in cache.special):
            words = []
            for piece in vocabulary.cut.split(text):
                words += [piece] if piece in cache.special else vocabulary.words.findall(piece)
        else:
            words = vocabulary.words.findall(text)
        waiting.append(words)
        size += len(text)
        if size >= BLOCK_BYTES:
            flush()
            size = 0
    flush()
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _decode(ids: pa.Array, path: str) -> pa.Array:
    vocabulary, _ = _worker_state(path)
    counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten()
    if flat.null_count:
        raise ValueError("a token id is null")
    flat = flat.to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(counts)])
    out: list[str] = []
    row = 0
    while row < len(counts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK_BYTES // 4, side="right")) - 1)
        token = flat[at[row] : at[stop]]
        if len(token) and (token.min() < 0 or token.max() >= len(vocabulary.known) or not vocabulary.known[token].all()):
            raise ValueError("a token id is outside the vocabulary")
        first, lengths = vocabulary.bytes_at[token], vocabulary.bytes_at[token + 1] - vocabulary.bytes_at[token]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = vocabulary.pool[np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)].tobytes()
        cuts = ends[at[row : stop + 1] - at[row]].tolist()
        out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        row = stop
    return pa.array(out, pa.string())


def encode(text: Column, path: str, cache_words: int = CACHE_WORDS) -> Column:
    """Token ids (array of int) of a text column; special tokens in a text are recognised, none are added."""
    return F.arrow_udf(lambda texts: _encode(texts, path, cache_words), T.ArrayType(T.IntegerType()))(text)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of token ids; special tokens are kept."""
    return F.arrow_udf(lambda column: _decode(column, path), T.StringType())(ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """Every row with ``tokens`` and ``decoded`` added (columns of these names are replaced; one named ``_bpe`` is refused)."""
    if "_bpe" in docs.columns:
        raise ValueError("a column name clashes")
    small_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    @F.arrow_udf(kind)
    def both(texts: pa.Array) -> pa.Array:  # one function, so that the tokens are made once for either column
        ids = _encode(texts, path, CACHE_WORDS)
        return pa.StructArray.from_arrays([ids, _decode(ids, path)], names=["tokens", "decoded"])

    added = docs.withColumn("_bpe", both(F.col(text_col)))
    return added.withColumns({"tokens": F.col("_bpe.tokens"), "decoded": F.col("_bpe.decoded")}).drop("_bpe")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    done = round_trip(docs.select("doc_id", "text"), path)
    return done.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
