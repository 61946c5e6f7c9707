"""Token ids of whole texts with a public vocabulary, inside Arrow tasks.

White space never takes part in a token of the vocabularies used here, so a text's ids are those
of its words one after the other.  Each worker keeps the ids of words it has met, bounded by
``WORDS_KEPT``, and sends only new words to the tokenizers library.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, compress, repeat
from operator import attrgetter
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps before it starts afresh, and bytes of text worked on at once.
WORDS_KEPT = 1_000_000
CHUNK_BYTES = 2 << 20
#: Marks that the vocabularies split from the letters before them.
MARKS = ".,!?;:*#$%&|"

#: The characters that stand for bytes: printable ones for themselves, the others from U+0100 on.
LATIN_END = "\u024f"
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Places(dict):
    """Numbers words as they are met and keeps the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


class Encoder:
    """Ids of texts; ``encode`` returns one flat array and the number of ids of each text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.model = self.tokenizer.model
        # Special tokens are found in the text as it stands; all else is lower-cased first.
        names = sorted((t.content.encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values()), reverse=True)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None
        self.hint = os.path.commonprefix([x.lower() for x in names])
        # Vocabularies that treat letters otherwise go the library's whole way.
        probes = ["a", "words", "año", "ÉTÉ", "straße", "thing", "ñöüç"]
        self.reset()
        self.plain_letters = self.letters(probes)[0] == list(chain.from_iterable(self.alone(probes)))

    def reset(self) -> None:
        self.place = Places()
        self.ends: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0
        # Place 0: no word, no ids.
        self.place[b""]
        self.place.new = []

    def letters(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of words of Latin letters, straight from the model, and how many each has (-1: none, as
        the word has other letters).

        What the vocabulary's normalizer does to such words is lower case, and what comes before the
        model is a character for each byte.
        """
        latin = [w for w in words if not w.isascii() and max(w) <= LATIN_END and "İ" not in w and unicodedata.is_normalized("NFC", w)]
        shown = "\n".join(latin).lower().encode("utf-8").decode("latin-1").translate(BYTE_CHARACTERS).split(BYTE_CHARACTERS[10])
        as_bytes = dict(zip(latin, shown, strict=True)) if latin else {}
        known = [w if w.isascii() else as_bytes.get(w) for w in words]
        ids, sizes = self.modelled([w for w in known if w is not None])
        sizes = iter(sizes)
        return ids, [-1 if w is None else next(sizes) for w in known]

    def modelled(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of words as the model takes them, and how many each has; a few words' tokens are held at once."""
        ids, sizes, number = [], [], attrgetter("id")
        for k in range(0, len(words), 128):
            found = list(map(self.model.tokenize, words[k : k + 128]))
            sizes += map(len, found)
            ids += map(number, chain.from_iterable(found))
        return ids, sizes

    def learn(self) -> None:
        """Encode the words met since the last call.

        Letters with marks behind them have the ids of the letters, which become known as a word of
        their own, and then those of the marks.
        """
        new, self.place.new = self.place.new, []
        first = len(self.place) - len(new)
        texts = b"\n".join(new).decode("utf-8").split("\n")
        plain, odd, marked, cores, runs = [], [], [], [], []
        simple = np.zeros(len(texts), bool)
        if self.plain_letters:
            raw = pa.array(texts, pa.string())
            simple = pc.and_(pc.string_is_ascii(raw), pc.ascii_is_alpha(raw)).to_numpy(zero_copy_only=False)
            self.keep(first + np.flatnonzero(simple), *self.modelled(list(compress(texts, simple))))
        for i in np.flatnonzero(~simple).tolist():
            t = texts[i]
            core = t.rstrip(MARKS)
            if not core.isalpha() or not core.isascii() and not unicodedata.normalize("NFC", core).lower()[-1].isalpha():
                # Not letters, or what they become ends in a sign, which belongs to the marks behind.
                odd.append(i)
            elif len(core) == len(t):
                plain.append(i)
            else:
                marked.append(i)
                cores.append(self.place[core.encode("utf-8")])
                runs.append(t[len(core) :])
        plain += range(len(texts), len(texts) + len(self.place.new))
        texts += [w.decode("utf-8") for w in self.place.new]
        self.place.new = []
        words = [texts[i] for i in plain]
        ids, sizes = self.letters(words) if self.plain_letters else ([], [-1] * len(words))
        plain, sizes = np.array(plain, np.int64), np.array(sizes, np.int64)
        self.keep(first + plain[sizes >= 0], ids, sizes[sizes >= 0])
        odd += plain[sizes < 0].tolist()
        found = self.alone([texts[i] for i in odd])
        self.keep(first + np.array(odd, np.int64), list(chain.from_iterable(found)), list(map(len, found)))
        if marked:
            at = np.array([cores, [self.marks(r) for r in runs]]).T
            self.keep(first + np.array(marked), gather(self.flat, self.starts[at].ravel(), self.sizes[at].ravel()), self.sizes[at].sum(axis=1))

    def keep(self, places: np.ndarray, ids: list[int] | np.ndarray, sizes: list[int] | np.ndarray) -> None:
        """Note the ids of the words at ``places``, one word after the other."""
        n, sizes = len(ids), np.asarray(sizes, np.int64)
        while len(self.place) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + n] = ids
        self.starts[places], self.sizes[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += n

    def alone(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.batch(texts, add_special_tokens=False)]

    def marks(self, run: str) -> int:
        """The place of a run of marks."""
        if run not in self.ends:
            self.ends[run] = place = self.place[run.encode("utf-8")]
            if self.place.new:
                self.place.new = []
                found = self.alone([run])[0]
                self.keep(np.array([place]), found, [len(found)])
        return self.ends[run]

    def words(self, raw: bytes) -> list[bytes]:
        """The words of a text in lower case, which is what the vocabulary holds, and its special tokens.

        A word that only lower case turns into a special token keeps its own case.
        """
        low = raw.lower()
        if self.special is None or self.hint not in low or not self.special.search(low):
            return low.split()
        out = []
        for i, part in enumerate(self.special.split(raw)):
            if i % 2:
                out.append(part)
            else:
                out += [w if self.special.search(w.lower()) else w.lower() for w in part.split()]
        return out

    def split(self, texts: list[str | None] | pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts (see ``words``), one after the other, and how many each has."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.string())
        low = pc.ascii_lower(texts)
        if self.special is not None and pc.any(pc.match_substring(low, self.hint)).as_py():
            found = [self.words(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()]
            return pa.array(chain.from_iterable(found), pa.string()), np.fromiter(map(len, found), np.int64, len(found))
        lists = pc.ascii_split_whitespace(low)
        words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        full = pc.not_equal(pc.binary_length(words), 0)
        return words.filter(full), np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(texts))

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > WORDS_KEPT:
            self.reset()
        words, counts = self.split(texts)
        # Each word of these texts is looked up once, and one of plain letters without the marks behind it.
        words = words.dictionary_encode()
        at, words = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        core = pc.ascii_rtrim(words, MARKS)
        plain = pc.and_(pc.string_is_ascii(core), pc.ascii_is_alpha(core))
        keys = pc.if_else(plain, core, words).dictionary_encode()
        runs = pc.if_else(plain, pc.ascii_ltrim(words, ascii_lowercase), "").dictionary_encode()
        known = keys.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.place.get, known, repeat(-1)), np.int64, len(known))
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            places[fresh] = len(self.place) + np.arange(len(fresh))
            self.place.new = known[fresh].tolist()
            self.place.update(zip(self.place.new, places[fresh].tolist(), strict=True))
            # Very many small objects and no cycles: the collector would only walk over them.
            running = gc.isenabled()
            gc.disable()
            try:
                self.learn()
            finally:
                if running:
                    gc.enable()
        ends = np.array([self.marks(r) if r else 0 for r in runs.dictionary.to_pylist()], np.int64)
        pairs = np.stack([places[keys.indices.to_numpy(zero_copy_only=False)], ends[runs.indices.to_numpy(zero_copy_only=False)]], axis=1)
        sizes = self.sizes[pairs]
        flat, sizes = gather(self.flat, self.starts[pairs].ravel(), sizes.ravel()), sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        sizes = sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return gather(flat, starts[at], sizes), np.diff(ends, prepend=0)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` for every start and size, one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(total)]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator) -> Iterator:
    """Arrow batches with a ``text`` column, cut into parts of some megabytes of text."""
    for b in batches:
        texts = b.column("text")
        at, size = 0, 0
        for i in range(len(texts)):
            size += texts[i].as_buffer().size if texts[i].is_valid else 0
            if size >= CHUNK_BYTES or i == len(texts) - 1:
                yield b.slice(at, i + 1 - at)
                at, size = i + 1, 0


def chunks(batches: Iterator) -> Iterator[tuple[list, list[str]]]:
    """``(doc_ids, texts)`` of Arrow batches of ``doc_id, text``, some megabytes of text at a time."""
    for b in slices(batches):
        yield b.column("doc_id").to_pylist(), b.column("text").to_pylist()


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by one end id."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1
