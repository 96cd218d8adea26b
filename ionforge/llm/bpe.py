"""BPE encoding and decoding with an existing vocabulary file, by batched merge rounds.

A batch of distinct words lies in one flat symbol array. Each round looks all
adjacent pairs up by binary search over the sorted pair keys, takes the lowest
rank of every word and merges it everywhere at once; words without a mergeable
pair leave the array. Texts are cut at white space, which no word crosses;
chunks met before come from a bounded per-worker store.

Defined results: null text counts as empty and has no tokens; texts of any
length are cut into words, never into prefixes; equal texts have equal ids;
strings of added tokens inside a text become that token; null ids decode to
the empty text and ids outside the vocabulary are skipped. An existing column
of the output's name is replaced, all other columns stay. Code points that
Python's Unicode tables don't assign yet have the class and the lower case that
the tokenizers library gives them.
"""

import json
import re
import unicodedata
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ionforge.llm.common import slices

NO_RANK = np.iinfo(np.int64).max
#: Characters of text whose words are held as Python objects at a time.
SLICE_CHARS = 1_000_000
#: Distinct chunks kept per worker before the store forgets those that occurred once.
STORE_CHUNKS = 250_000
# The pre-tokenizer of the vocabulary file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
CHUNKS = regex.compile(r"\S+")
#: Separators to ``str.split`` but not to the pre-tokenizer.
CONTROLS = re.compile("[\x1c-\x1f]")
#: A character of each class that is part of no contraction: letter, number, white space, other.
SHAPES = {1: "a", 4: "1", 2: " ", 3: "!"}


#: Characters met that Python's Unicode tables assign.
ASSIGNED = set(map(chr, range(128)))


def unassigned(text):
    """The characters of a text that Python's Unicode tables don't assign."""
    fresh = set(text) - ASSIGNED
    if not fresh:
        return fresh
    free = {c for c in fresh if unicodedata.category(c) == "Cn"}
    ASSIGNED.update(fresh - free)
    return free


class Store(dict):
    """Chunks by number; a chunk met for the first time gets the next number and is listed as fresh."""

    def __init__(self, known):
        super().__init__(zip(known, range(len(known))))
        self.fresh = []

    def __missing__(self, chunk):
        self[chunk] = number = len(self)
        self.fresh.append(chunk)
        return number


def byte_letters():
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


def appended(store, used, more):
    """A store with more values behind the used ones, at twice the room when it is full."""
    need = used + len(more)
    if need > len(store):
        store = np.resize(store, max(need, 2 * len(store)))
    store[used:need] = more
    return store


class Vocabulary:
    """Merges as sorted integer keys, byte symbols as tables, and the store of encoded words."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.path = path
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        names = [None] * self.size
        for token, i in [*ids.items(), *self.added.items()]:
            names[i] = token
        self.names = pa.array(names, pa.large_string())
        letters = byte_letters()
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[letters[b] + suffix] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.all_at_once = self._ordered(left, right, made)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.reset()

    def _ordered(self, left, right, made):
        """Whether no merge can use a symbol before the last merge that makes it.

        Then merging every occurrence of a word's best pair in one round gives
        the same symbols as merging them one by one.
        """
        rank = np.arange(len(made))
        last_made = np.full(self.size, -1)
        np.maximum.at(last_made, made, rank)
        return bool((np.maximum(last_made[left], last_made[right]) < rank).all())

    def reset(self):
        # white space keeps an added token's key apart from any chunk
        self.known = Store([f" {token}" for token in self.added])
        self.flat = np.array(list(self.added.values()), np.int32)
        self.start = np.arange(len(self.added) + 1, dtype=np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget(self):
        """Keep the chunks that occurred more than once, at most half as many as fit, and halve their counts."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > STORE_CHUNKS // 2:
            kept = np.sort(kept[np.argsort(self.uses[kept], kind="stable")[-(STORE_CHUNKS // 2) :]])
        own = np.arange(len(self.added))
        kept = np.concatenate([own, kept[kept >= len(own)]])
        names = list(self.known)
        self.known = Store([names[i] for i in kept.tolist()])
        self.flat, size = gathered(self.flat, self.start, kept)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.uses = self.uses[kept] // 2

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ranks(self, sym, word, at):
        """Rank of the pair at each position, by binary search over the sorted pair keys."""
        after = np.minimum(at + 1, len(sym) - 1)
        pair = sym[at] * self.size + sym[after]
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = (self.keys[found] == pair) & (word[at] == word[after]) & (after > at)
        return np.where(hit, self.rank[found], NO_RANK)

    def merge(self, words):
        """Ids of byte-string words: one flat array and the number of ids of each word."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(n), size)
        last = np.cumsum(size) - 1
        sym[last] = self.final[raw[last]]
        rank = self.ranks(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            fresh = np.concatenate([[True], word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
            active = best < NO_RANK
            done_sym.append(sym[~active])
            done_word.append(word[~active])
            sym, word, rank, best = sym[active], word[active], rank[active], best[active]
            chosen = np.flatnonzero(rank == best)
            if self.all_at_once:  # of overlapping equal pairs, every second from the left
                fresh = np.ones(len(chosen), bool)
                fresh[1:] = np.diff(chosen) != 1
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            else:  # only the leftmost of each word
                chosen = chosen[np.unique(word[chosen], return_index=True)[1]]
            sym[chosen] = self.made[rank[chosen]]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # only the pairs beside a new symbol have changed
            now = chosen - np.arange(len(chosen))
            changed = np.concatenate([now, now[now > 0] - 1])
            rank[changed] = self.ranks(sym, word, changed)
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=n)

    def shape(self, letter):
        """A character that stands for the class of an unassigned one, as the library cuts it."""
        return SHAPES[len(self.library.pre_tokenizer.pre_tokenize_str(f"a{letter * 2}a"))]

    def chunks(self, text):
        """Chunks of a text in order; an added token is a chunk of its own."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        found = []
        for i, part in enumerate(self.split_added.split(text)):
            found.extend([f" {part}"] if i % 2 else self._plain(part))
        return found

    def _plain(self, text):
        if not text.isascii():
            if unassigned(text):
                text = self.library.normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letter by letter: no special form at the end of a word
                text = text.replace("Σ", "σ")
        text = text.lower()
        return CHUNKS.findall(text) if CONTROLS.search(text) else text.split()

    def words(self, chunk):
        """Words of a chunk in lower case."""
        if chunk.isascii() and not CONTROLS.search(chunk):
            return ASCII_WORDS.findall(chunk)
        free = unassigned(chunk)
        shape = chunk.translate({ord(c): self.shape(c) for c in free}) if free else chunk
        return [chunk[m.start() : m.end()] for m in WORDS.finditer(shape)]

    def learn(self, fresh):
        """Encode chunks met for the first time and append them to the store."""
        found = [(c,) if c.isalpha() else self.words(c) for c in fresh]
        counts = list(map(len, found))
        words = list(chain.from_iterable(found))
        number = Store([])
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        flat, size = self.merge([w.encode("utf-8", "surrogatepass") for w in number.fresh])
        ids, size = gathered(flat, np.concatenate([[0], np.cumsum(size)]), at)
        size = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])
        used = len(self.known) - len(fresh)
        self.flat = appended(self.flat, self.start[used], ids)
        self.start = appended(self.start, used + 1, self.start[used] + np.cumsum(size))

    def encode(self, texts):
        """Ids of all texts in one flat array, and the number of ids of each text."""
        chunks, counts = [], []
        for text in texts:
            found = self.chunks(text)
            chunks.extend(found)
            counts.append(len(found))
        if len(self.known) > STORE_CHUNKS:
            self.forget()
        self.known.fresh = []
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if self.known.fresh:
            self.learn(self.known.fresh)
        uses = np.bincount(at, minlength=len(self.known))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        ids, size = gathered(self.flat, self.start, at)
        bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, np.diff(bounds)


def gathered(flat, start, at):
    """The runs of a flat array that the numbers name, one after another, and their sizes."""
    size = start[at + 1] - start[at]
    ends = np.cumsum(size)
    offset = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    return flat[np.repeat(start[at], size) + offset], size


@lru_cache(maxsize=4)
def vocabulary(path):
    return Vocabulary(path)


def encode(df, vocab_path, text_col="text", ids_col="token_ids"):
    """Add the token ids of every whole text as ``array<int>``."""
    rows = df.drop(ids_col)

    def run(batches):
        v = vocabulary(vocab_path)
        for batch in batches:
            text = pc.fill_null(batch.column(text_col), "")
            for a, b in slices(pc.utf8_length(text).to_pylist(), SLICE_CHARS):
                ids, size = v.encode(text.slice(a, b - a).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*part.schema.names, ids_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(df, vocab_path, ids_col="token_ids", out_col="decoded"):
    """Add the text of every id list: its tokens joined by one space, as the vocabulary names no decoder."""
    rows = df.drop(out_col)

    def run(batches):
        v = vocabulary(vocab_path)
        for batch in batches:
            ids = batch.column(ids_col)
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_pylist()
            for a, b in slices(sizes, SLICE_CHARS):
                part = batch.slice(a, b - a)
                flat = np.asarray(ids.slice(a, b - a).flatten().fill_null(-1), np.int64)
                size = np.array(sizes[a:b], np.int64)
                fine = (flat >= 0) & (flat < v.size)
                if not fine.all():
                    size = np.bincount(np.repeat(np.arange(b - a), size)[fine], minlength=b - a)
                    flat = flat[fine]
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]))
                names = pa.LargeListArray.from_arrays(offsets, v.names.take(pa.array(flat)))
                text = pc.binary_join(names, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, out_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out_col, StringType())]))
