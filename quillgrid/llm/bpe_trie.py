"""BPE encoding by a prefix-sharing trie traversal, and decoding, for vocabularies with word ends.

The encodings of a word's prefixes form chains: that of a prefix is that of a shorter one and one last token, and
which token is last follows from the pairs of neighbours that merging leaves apart. So distinct words go into a trie,
and a depth-first walk computes each node's last token once, for all words that share the prefix. The tokens that end
at a node come from an automaton over the vocabulary, one step a node. Whole words end in symbols of their own (those
with the word-end suffix), looked up where a word ends.

Texts are cut at white space first: neither normalisation nor the pattern of pre-tokens crosses it. The distinct pieces
of a run of texts are cut into words in one pass; words seen lately are remembered, and tokens are gathered by numpy.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import textkernel as tk
from .common import table, text_of, without

SUFFIX = "</w>"
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = regex.compile(rf"[^{_SPACE}]+")
_BREAK = regex.compile(rf"[{_SPACE}]")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+|\n")
#: Characters that Python's split takes for white space and the tokenizer doesn't.
_NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Words that a worker remembers, words that one trie holds, and pairs of tokens judged.
REMEMBERED, TRIE_WORDS, PAIRS = 400_000, 30_000, 300_000
#: Bytes of text whose pieces are learnt together; characters whose results are sent together, and of text cut at once.
LEARN_BYTES, SEND_CHARS, CUT_CHARS = 6_000_000, 1_000_000, 1_000_000
#: Tokens that are decoded together.
DECODE_TOKENS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Numbers(dict):
    """Numbers for keys, in order of first appearance."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Ragged:
    """Lists of token ids side by side: list i is `flat[first[i]:first[i] + n[i]]`."""

    def __init__(self, n: np.ndarray, flat: np.ndarray):
        self.n, self.flat = n.astype(np.int64), flat
        self.first = np.cumsum(self.n) - self.n

    def take(self, at: np.ndarray) -> Ragged:
        n = self.n[at]
        ends = np.cumsum(n)
        where = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        where += np.repeat(self.first[at] - ends + n, n)
        return Ragged(n, self.flat[where])

    def grouped(self, sizes: np.ndarray) -> Ragged:
        """Runs of so many lists, each as one list."""
        upto = np.append(0, np.cumsum(self.n))
        ends = np.append(0, np.cumsum(sizes))
        return Ragged(np.diff(upto[ends]), self.flat)


class Bpe:
    """A vocabulary: encodes words by a trie of them."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(SUFFIX)}
        self.final = {t[: -len(SUFFIX)]: i for t, i in vocab.items() if t.endswith(SUFFIX)}
        #: Two tokens -> the one that they make; token -> the two that make it; and the rank of that merge.
        self.merged: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in self.split or max(self.born.get(x, -1), self.born.get(y, -1)) >= r:
                raise ValueError(f"merge {r}: the trie needs one merge a token, and parts that are merged before")
            self.split[z] = x, y
            self.merged[self.split[z]] = z
            self.born[z] = r
        self.name_of = pa.array([self.names.get(i) for i in range(max(self.names) + 1)], pa.string())
        self.chars = {b: c for b, c in enumerate(byte_chars())}
        self.whole: dict[int, bool] = {}
        self.edges: dict[int, tuple[list[tuple[int, float]], list[tuple[int, float]]]] = {}
        self.pairs: dict[int, bool] = {}
        self._automaton()
        self.forget()

    def _automaton(self) -> None:
        """States are the prefixes of tokens; each knows the tokens, inner or final, that are suffixes of it, longest first."""
        self.goto: list[dict[str, int]] = [{}]
        inner: list[int] = [-1]
        final: list[int] = [-1]
        for names, ends in ((self.inner, inner), (self.final, final)):
            for name, token in names.items():
                at = 0
                for c in name:
                    nxt = self.goto[at].get(c)
                    if nxt is None:
                        nxt = self.goto[at][c] = len(self.goto)
                        self.goto.append({})
                        inner.append(-1)
                        final.append(-1)
                    at = nxt
                ends[at] = token
        size = len(self.goto)
        self.fail = [0] * size
        self.ends_inner: list[tuple[tuple[int, int], ...]] = [()] * size
        self.ends_final: list[tuple[tuple[int, int], ...]] = [()] * size
        level, depth = list(self.goto[0].values()), 1
        while level:
            below = []
            for at in level:
                back = self.fail[at]
                for ends, known in ((inner, self.ends_inner), (final, self.ends_final)):
                    known[at] = ((ends[at], depth), *known[back]) if ends[at] >= 0 else known[back]
                for c, nxt in self.goto[at].items():
                    self.fail[nxt] = self.step(back, c)
                    below.append(nxt)
            level, depth = below, depth + 1

    def step(self, state: int, c: str) -> int:
        """The longest prefix of a token that the state's text and a character end in."""
        goto, fail = self.goto, self.fail
        while True:
            nxt = goto[state].get(c)
            if nxt is not None:
                return nxt
            if not state:
                return 0
            state = fail[state]

    def _is_whole(self, token: int, end: bool) -> bool:
        """Does a token's own text encode to it?"""
        name = self.names[token]
        got = self.whole[token] = self.merge(name[: -len(SUFFIX)] if end else name, end) == [token]
        return got

    def merge(self, word: str, end: bool = True) -> list[int]:
        """The plain way: merge the best-ranked pair until none is left."""
        ids = [self.inner[c] for c in word[:-1]] + [self.final[word[-1]] if end else self.inner[word[-1]]]
        while len(ids) > 1:
            r, i = min((self.born.get(self.merged.get(p), 1 << 30), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if r == 1 << 30:
                break
            ids[i : i + 2] = [self.merged[ids[i], ids[i + 1]]]
        return ids

    def _edge(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        """What stands at a token's right and at its left end while it is built: tokens, each with the rank that absorbs it."""
        got = self.edges.get(token)
        if got is None:
            sides: list[list[tuple[int, float]]] = []
            for side in (1, 0):
                at, until, out = token, float("inf"), []
                while True:
                    out.append((at, until))
                    if at not in self.split:
                        break
                    until = self.born[at]
                    at = self.split[at][side]
                sides.append(out)
            got = self.edges[token] = sides[0], sides[1]
        return got

    def _stay(self, a: int, b: int) -> bool:
        """Do two neighbouring tokens stay apart?

        They don't if some token at a's right end merges with one at b's left end before either is absorbed by its own
        token. Merges go by rank, so a token lasts from its rank to that of the merge that absorbs it; of equal merges
        the left one comes first.
        """
        for x, x_until in self._edge(a)[0]:
            for y, y_until in self._edge(b)[1]:
                z = self.merged.get((x, y))
                if z is not None and self.born[z] < x_until and self.born[z] <= y_until:
                    return False
        return True

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Byte-level words -> token ids, by one trie of all of them."""
        root: dict = {}
        depth = 1
        for w in words:
            node = root
            depth = max(depth, len(w))
            for c in w[:-1]:
                nxt = node.get(c)
                if nxt is None:
                    nxt = node[c] = {}
                node = nxt
            node.setdefault("", []).append(w)  # a word's last character is a symbol of another kind
        out: dict[str, list[int]] = {}
        goto, fail, ends_inner, ends_final = self.goto, self.fail, self.ends_inner, self.ends_final
        whole, pairs, size = self.whole, self.pairs, len(self.name_of)
        if len(pairs) > PAIRS:
            pairs.clear()

        def last_token(ends: tuple[tuple[int, int], ...], n: int, end: bool) -> tuple[int, int]:
            for t, k in ends:
                ok = whole.get(t)
                if ok is None:
                    ok = self._is_whole(t, end)
                if ok:
                    if k == n:
                        return t, 0
                    a = last[n - k]
                    pair = a * size + t
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = pairs[pair] = self._stay(a, t)
                    if ok:
                        return t, n - k
            raise ValueError("a word without an encoding")

        # last[n]: the last token of the first n characters of the path; back[n]: the length of what stands before it.
        last, back = [-1] * (depth + 1), [0] * (depth + 1)
        stack: list[tuple[dict, int, int]] = [(root, 0, 0)]
        while stack:
            node, n, state = stack.pop()
            if n:
                last[n], back[n] = last_token(ends_inner[state], n, False)
            for c, child in node.items():
                if c:
                    at = state
                    while True:  # `step`, in place
                        nxt = goto[at].get(c)
                        if nxt is not None or not at:
                            break
                        at = fail[at]
                    stack.append((child, n + 1, nxt or 0))
                    continue
                for word in child:
                    t, at = last_token(ends_final[self.step(state, word[-1])], n + 1, True)
                    ids = [t]
                    while at:
                        ids.append(last[at])
                        at = back[at]
                    ids.reverse()
                    out[word] = ids
        return out

    def _words(self, pieces: list[str]) -> list[str | int]:
        """Pieces without white space, each followed by a line end -> words, ids of special tokens, and those line ends."""
        joined = "\n".join(pieces) + "\n"
        if self.cut is None or not self.cut.search(joined):
            # Only a capital sigma has a lower case that depends on its neighbours; the tokenizer's does not.
            return _WORDS.findall(unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower())
        out: list[str | int] = []
        for part in self.cut.split(joined):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(_WORDS.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()))
        return out

    def pieces(self, text: str) -> list[str]:
        return _PIECES.findall(text) if _NOT_SPACE.search(text) else text.split()

    def _learn(self, words: Iterable[str]) -> None:
        """Number these words in `known`, and append their tokens to the store."""
        new = sorted(words)  # neighbours share prefixes
        codes: list[np.ndarray] = [self.flat]
        sizes: list[np.ndarray] = [self.sizes]
        collect = gc.isenabled()
        gc.disable()  # a trie is many small dicts and no cycle
        for i in range(0, len(new), TRIE_WORDS):
            part = new[i : i + TRIE_WORDS]
            byte_level = [w if w.isascii() and w.isprintable() else "".join([self.chars[b] for b in w.encode()]) for w in part]
            got = self.encode_words(byte_level)
            lists = [got[w] for w in byte_level]
            sizes.append(np.fromiter(map(len, lists), np.int32, len(lists)))
            codes.append(np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
            for w in part:
                self.known[w]  # numbers it
        if collect:
            gc.enable()
        self.flat, self.sizes = np.concatenate(codes), np.concatenate(sizes)

    def encode_pieces(self, pieces: list[str]) -> Ragged:
        """The ids of each piece."""
        if not pieces:
            return Ragged(np.zeros(0, np.int64), np.zeros(0, np.int32))
        found = self._words(pieces)
        if len(self.known) > REMEMBERED:
            self.known, self.flat, self.sizes = _Numbers({"\n": 0}), np.zeros(0, np.int32), np.zeros(1, np.int32)
        distinct = set(found)
        distinct.discard("\n")
        special = {w for w in distinct if isinstance(w, int)}
        self._learn(w for w in distinct if w not in self.known and w not in special)
        # Line ends get number 0 of the store, which is the empty list, and special tokens the lists after it.
        number = {"\n": 0, **{t: len(self.known) + i for i, t in enumerate(sorted(special))}}
        known = self.known
        if special:
            at = np.array([number[w] if w in number else known[w] for w in found], dtype=np.int64)
        else:
            at = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        tokens = Ragged(np.append(self.sizes, np.ones(len(special), np.int32)), np.append(self.flat, np.array(sorted(special), np.int32)))
        ends = np.flatnonzero(at == 0) + 1
        return tokens.take(at).grouped(np.diff(ends, prepend=0))

    def forget(self) -> None:
        """Free what only speeds things up."""
        self.pairs.clear()
        self.edges.clear()
        self.known = _Numbers({"\n": 0})
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(self.pieces(text)).flat.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder of its own, this kind of tokenizer joins its tokens' names by spaces."""
        return " ".join([self.names[i] for i in ids])

    def decode_lists(self, lists: pa.ListArray) -> pa.StringArray:
        """`decode` of each list of ids, null of a null list; an id that the vocabulary lacks is an error."""
        ids = lists.flatten()
        if len(ids) and (ids.null_count or pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(self.name_of)):
            raise ValueError("ids outside the vocabulary")
        names = self.name_of.take(ids)
        if names.null_count:
            raise ValueError("ids outside the vocabulary")
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        out = pc.binary_join(pa.ListArray.from_arrays(ends, names), " ")
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.string())) if lists.null_count else out


_loaded: dict[str, Bpe] = {}


def bpe(raw: str) -> Bpe:
    """The vocabulary of a tokenizer file's text; a worker keeps one."""
    key = hashlib.md5(raw.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(raw)
    return _loaded[key]


def _unload() -> None:
    """A worker lives on after its task, for other work: it gives the vocabulary's memory back, which is soon read again."""
    _loaded.clear()
    gc.collect()
    tk.release()


def _groups(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of a bounded number of characters; a longer text is a run of its own."""
    lo, end, n = 0, len(texts), 0
    for i in range(end):
        if i > lo and n + len(texts[i]) > most:
            yield lo, i
            lo, n = i, 0
        n += len(texts[i])
    if lo < end:
        yield lo, end


def _shipped(docs: DataFrame, path: str | None) -> Broadcast:
    with open(path or default_path(), encoding="utf-8") as f:
        raw = f.read()
    # A vocabulary file has a fixed size, whatever the input.
    return docs.sparkSession.sparkContext.broadcast(raw)


def _cut(v: Bpe, text: str, numbers: _Numbers) -> np.ndarray:
    """A text's pieces as numbers; a long text is cut at white space first, so only few of its pieces are held at once."""
    out, lo = [], 0
    while lo < len(text):
        hi = lo + CUT_CHARS
        if hi < len(text):
            stop = _BREAK.search(text, hi)
            hi = stop.start() if stop else len(text)
        pieces = v.pieces(text[lo:hi] if lo or hi < len(text) else text)
        out.append(np.fromiter(map(numbers.__getitem__, pieces), np.int32, len(pieces)))
        lo = hi
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int32), *out])


def _encoded(v: Bpe, column: pa.Array) -> Iterator[tuple[int, int, pa.ListArray]]:
    """lo, hi and the ids of texts lo..hi, a run of a bounded size at a time (a longer text is a run of its own)."""
    for b in tk.blocks(column, LEARN_BYTES):
        texts = ["" if t is None else t for t in column.slice(b.lo, b.n).to_pylist()]
        numbers = _Numbers()
        cut = [_cut(v, t, numbers) for t in texts]
        bounds = list(_groups(texts, SEND_CHARS))
        del texts
        tokens = v.encode_pieces(list(numbers))
        del numbers
        for lo, hi in bounds:
            got = tokens.take(np.concatenate(cut[lo:hi])).grouped(np.array([len(x) for x in cut[lo:hi]]))
            yield b.lo + lo, b.lo + hi, pa.ListArray.from_arrays(pa.array(np.append(got.first, len(got.flat)).astype(np.int32)), pa.array(got.flat))


def _mapped(docs: DataFrame, path: str | None, text_col: str, schema: str, make: Callable[[Bpe, pa.ListArray], list[pa.Array]]) -> DataFrame:
    """docs with the columns that `make(vocabulary, ids of each text)` gives in place of the text, a run of texts at a time."""
    shipped = _shipped(docs, path)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe(shipped.value)
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n != text_col]
            for lo, hi, ids in _encoded(vocabulary, batch.column(batch.schema.get_field_index(text_col))):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in keep), *make(vocabulary, ids)], names=[*(batch.schema.names[i] for i in keep), *names])
        del vocabulary
        _unload()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)
    return docs.mapInArrow(run, f"{kept}, {schema}")


def _sha(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())


def _digests(v: Bpe, ids: pa.ListArray) -> list[pa.Array]:
    """Number of ids, the digest of the ids and that of what these ids decode to."""
    written = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
    return [ids.value_lengths().cast(pa.int64()), _sha(written), _sha(v.decode_lists(ids))]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens long and ids array<int> in place of the text column; a null text is the empty one.

    path: a tokenizer file of byte-level BPE with word ends. Extra columns stay; columns named n_tokens or ids are replaced.
    Rows are independent: ids and texts may repeat, and an empty table gives an empty result.
    """
    docs = without(docs, "n_tokens", "ids")
    return _mapped(docs, path, text_col, "n_tokens long, ids array<int>", lambda _, ids: [ids.value_lengths().cast(pa.int64()), ids])


def encode_checked(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """As `encode`, with decoded_sha256 string: the digest of what `decode` gives for these ids, by the worker that has them."""
    docs = without(docs, "n_tokens", "ids", "decoded_sha256")
    return _mapped(docs, path, text_col, "n_tokens long, ids array<int>, decoded_sha256 string", lambda v, ids: [ids.value_lengths().cast(pa.int64()), ids, _sha(v.decode_lists(ids))])


def decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with decoded string, what their ids decode to; null ids give null. A column named decoded is replaced."""
    docs = without(docs, "decoded")
    shipped = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe(shipped.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + DECODE_TOKENS, side="right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, vocabulary.decode_lists(lists.slice(lo, hi - lo))], names=[*batch.schema.names, "decoded"])
                lo = hi
        del vocabulary
        _unload()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kept}, decoded string")


def digests(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 in place of the text column: what encode gives and what those ids decode to, hashed; columns of these names are replaced."""
    docs = without(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    return _mapped(docs, path, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its number of tokens and the digests of its ids and of what they decode to; a null text is empty."""
    return digests(text_of(table(spark, sf_dir, "documents")))
