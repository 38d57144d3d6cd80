"""Byte-level BPE ids of whole texts by the tokenizers library, each different word of a batch once, with a bounded memo.

Arrow splits texts at single blanks, line ends and final marks and finds the different words; only these go through Python, and numpy puts the ids of
the texts together. Texts with runs of white space or with special tokens are split by a regular expression instead. Both
give the ids of encoding the whole text; special tokens of the vocabulary become their ids, as the library does by default.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A byte-level BPE with the usual pattern never joins what lies before and after the last space before a
#: character that isn't white space, so words can be encoded apart. Runs of other white space stay inside a piece.
CUT = re.compile(r" (?=\S)")
#: Latin letters at the start of a word; they never join what follows them.
STEM = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
MEMO_WORDS, MEMO_CHARS = 500_000, 48
#: Words of the dictionaries behind it, for odd texts and for the letters and marks that words are put together from.
PART_WORDS = 30_000
#: A blank or line end that isn't a cut, or may not be one: before white space of any kind, or last; and the mark below.
NO_CUT = r"[ \n](?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)|\x01"
#: Marks behind a word never join it; they become a word of their own, with a control character for the blank that they lack.
MARKS, APART = r"(\p{L})([.,;:!?]+)( |\n|$)", "\\1 \x01\\2\\3"
#: Words whose ids are put together at once.
WORDS_AT_ONCE = 1 << 17
#: Bytes of texts that are encoded together.
GATHERED = 3 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo(dict):
    """Ids of words as bytes, made where they are missing. It keeps the first words it meets, which are the frequent ones; others go with ``forget``."""

    def __init__(self, make: Callable[[Memo, str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.passing = make, most, []

    def __missing__(self, word: str) -> bytes:
        out = self.make(self, word)
        if len(self) >= self.most or len(word) > MEMO_CHARS:
            self.passing.append(word)
        self[word] = out
        return out

    def forget(self) -> None:
        for w in self.passing:
            del self[w]
        self.passing.clear()


class Known:
    """Words after a blank with their ids, in arrays: the first ``most`` words that it meets, which hold the frequent ones."""

    def __init__(self, make: Callable[[str], bytes], dtype: np.dtype, most: int):
        self.make, self.dtype, self.most = make, dtype, most
        self.words, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, dtype), np.zeros(0, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A string of ids, and for each of the different ``words`` where its ids begin and how many they are."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null()
        fresh = words.filter(new)
        parts = list(map(self.make, fresh.to_pylist()))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        ids, all_sizes = np.concatenate([self.ids, np.frombuffer(b"".join(parts), self.dtype)]), np.concatenate([self.sizes, sizes])
        where = at.fill_null(0).to_numpy().astype(np.int64)
        where[new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(fresh))
        begins = np.cumsum(all_sizes) - all_sizes
        if room := min(self.most - len(self.words), len(fresh)):
            short = pc.less_equal(pc.utf8_length(fresh), MEMO_CHARS).to_numpy(zero_copy_only=False)
            short &= np.cumsum(short) <= room
            self.words = pa.concat_arrays([self.words, fresh.filter(pa.array(short))])
            self.ids, self.sizes = np.concatenate([self.ids, ids[len(self.ids) :][np.repeat(short, sizes)]]), np.concatenate([self.sizes, sizes[short]])
        return ids, begins[where], all_sizes[where]


class WordEncoder:
    """Ids of texts, equal to those of encoding them whole."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = {t.content: array(self.code, [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves in the model's alphabet
        self.alphabet = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.heads, self.rest, self.tails = Memo(self._word, PART_WORDS), Memo(self._word, PART_WORDS), Memo(lambda _, w: self._ids(w), PART_WORDS)
        self.known = Known(self._unit, self.dtype, memo_words)

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _letters(self, before: str, word: str) -> bytes:
        """Ids of a blank (or nothing) and letters: one piece for the model, in its alphabet of bytes."""
        if word.isascii():
            piece = "\u0120" + word if before else word
        else:
            piece = (before + word).encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, memo: Memo, word: str) -> bytes:
        """Letters go to the model as they are; letters and other characters behind them are put together from both."""
        before = " " if memo is self.rest else ""
        if word.isascii() and word.isalpha():
            return self._letters(before, word)
        m = STEM.match(word)
        if not m or len(word) > MEMO_CHARS:
            return self._ids(before + word)
        if m.end() == len(word):
            return self._letters(before, word)
        return memo[m[0]] + self.tails[word[m.end() :]]

    def _unit(self, word: str) -> bytes:
        """A word after a blank; or, by its first character, marks behind a word, or a line end and the word after it."""
        if word[:1] == "\x01":
            return self.tails[word[1:]]
        if word[:1] == "\n":
            return self.tails["\n"] + self._word(self.heads, word[1:])
        return self._word(self.rest, word)

    def _split(self, text: str) -> bytes:
        """A text without special tokens."""
        p = CUT.split(text)
        return self.heads[p[0]] + b"".join(map(self.rest.__getitem__, p[1:]))

    def _any(self, text: str) -> bytes:
        """A text that may hold special tokens; what lies between them is encoded apart."""
        if not self.marks:
            return self._split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self._split(text[at:])])

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each of ``texts``, in which every blank and line end is a cut and no special token occurs."""
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, MARKS, APART), "\n", " \n"), " ")
        begins = lists.offsets.to_numpy()
        words = lists.values.slice(begins[0], begins[-1] - begins[0]).dictionary_encode()
        begins = begins[:-1] - begins[0]
        codes, first = words.indices.to_numpy().copy(), words.dictionary.take(words.indices.take(pa.array(begins))).to_pylist()
        heads = list(map(self.heads.__getitem__, first))
        flat, starts, sizes = self.known.look_up(words.dictionary)
        codes[begins] = len(sizes) + np.arange(len(begins))  # the first word of a text has no blank before it
        of_heads = np.fromiter(map(len, heads), np.int64, len(heads)) // self.dtype.itemsize
        starts, sizes = np.concatenate([starts, len(flat) + np.cumsum(of_heads) - of_heads]), np.concatenate([sizes, of_heads])
        flat, out = np.concatenate([flat, np.frombuffer(b"".join(heads), self.dtype)]), []
        for i in range(0, len(codes), WORDS_AT_ONCE):
            some = codes[i : i + WORDS_AT_ONCE]
            n = sizes[some]
            out.append(flat[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(out), np.add.reduceat(sizes[codes], begins)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (strings without nulls) after each other, and their number for each text."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, NO_CUT)
        for mark in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            out = self._simple(texts)
        else:
            raw = [self._any(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            simple, n = self._simple(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
            counts = np.zeros(len(texts), np.int64)
            counts[odd], counts[~odd] = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize, n
            ids, of_odd = np.empty(counts.sum(), self.dtype), np.repeat(odd, counts)
            ids[of_odd], ids[~of_odd] = np.frombuffer(b"".join(raw), self.dtype), simple
            out = ids, counts
        for memo in (self.heads, self.rest, self.tails):
            memo.forget()
        return out

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``flat``, with ``end_id`` behind each text."""
        ids, counts = self.flat(texts)
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian bytes of ``dtype``."""
        ids, counts = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(counts).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches put together to some ``size`` bytes, so that words repeat in them; a batch is never split."""
    some, total = [], 0
    for b in batches:
        if some and total + b.nbytes > size:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, total = [], 0
        if b.num_rows:
            some.append(b)
            total += b.nbytes
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> WordEncoder:
    """One encoder (and memo) for each worker process; ``memo_words`` words are some 60 bytes each."""
    if (path, memo_words) not in _ENCODERS:
        _ENCODERS[path, memo_words] = WordEncoder(path, memo_words)
    return _ENCODERS[path, memo_words]
