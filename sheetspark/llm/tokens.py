"""Token ids of whole texts, with one look-up for each different word of a group."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from .common import IS_BLANK, numbered_words

VOCABULARY = "word_bpe_49k.json"
#: ASCII punctuation but for the apostrophe, which can begin a token of letters.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
MOST_WORDS = 400_000
GROUP_BYTES = 2_000_000


def _byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands
    for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def _kinds(members: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(members, np.uint8))


IS_PUNCTUATION, IS_SMALL = _kinds(PUNCTUATION), _kinds(b"abcdefghijklmnopqrstuvwxyz0123456789")


def _lowered(raw: bytes) -> bytearray:
    """UTF-8 with A-Z and the letters À-Þ in lower case; 0xC3 leads the latter, and no other bytes."""
    low = bytearray(raw.lower())
    x = np.frombuffer(low, np.uint8)
    at = np.flatnonzero(x[:-1] == 0xC3) + 1
    x[at[(x[at] >= 0x80) & (x[at] <= 0x9E) & (x[at] != 0x97)]] += 0x20
    return low


def _final_punctuation(low: bytes | bytearray) -> np.ndarray:
    """Where punctuation up to a blank begins after a letter (a-z, ß-ÿ) or digit. A blank closes ``low``."""
    x = np.frombuffer(low, np.uint8)
    marks = IS_PUNCTUATION[x]
    begins = np.flatnonzero(marks[1:] & ~marks[:-1]) + 1
    ends = np.flatnonzero(marks[:-1] & ~marks[1:]) + 1
    ends = ends[np.searchsorted(ends, begins)]
    last = x[begins - 1]
    letter = IS_SMALL[last] | ((x[begins - 2] == 0xC3) & (last >= 0x9F) & (last <= 0xBF) & (last != 0xB7))
    return begins[letter & IS_BLANK[x[ends]]]


def vocabulary_path(path: str | None) -> str:
    """The file given, or the public vocabulary of words where it is installed."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordIds:
    """Ids of texts under a BPE vocabulary with word ends (32-bit little-endian).

    The vocabulary drops white space, lowers case and never joins across white
    space, so a text's ids are those of its words one after the other. Final
    punctuation is a word of its own. Ids are kept for the words seen last. Letters
    alone go to the vocabulary's merges directly, all else, and texts that may hold
    a special token, through the whole tokenizer.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        #: The merges alone: words spelled in the vocabulary's letters, one blank between.
        self.bare = Tokenizer.from_file(vocabulary_path(path))
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = {b: letter for b, letter in enumerate(_byte_letters()) if b != 0x20}
        self.words: dict[bytes, bytes] = {}

    def kind(self, *more: int) -> str:
        """Smallest whole numbers that hold every id of the vocabulary and these."""
        return "<u2" if max(len(self.ends) - 1, *more) < 1 << 16 else "<u4"

    def _exact(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _spelled(self, stems: list[bytes]) -> None:
        """Ids of stems of letters only, encoded as lines of many and parted at the
        tokens that end a word."""
        stems.sort(key=bytes.isascii)
        for i in range(0, len(stems), 4000):
            part = stems[i : i + 4000]
            line = b" ".join(part).decode("latin-1")
            if not line.isascii():
                line = line.translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.words.update(zip(part, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    def _learn(self, unknown: list[bytes]) -> None:
        simple = []
        for word in unknown:
            if word.isalpha() or LETTERS.fullmatch(text := word.decode("utf-8", "replace")):
                simple.append(word)
            else:
                self.words[word] = self._exact(text)
        self._spelled(simple)

    def encode(self, texts: Iterable[bytes | str | None], end_id: int | None = None) -> Iterator[memoryview]:
        """Bytes of the ids of each text, in order, closed by ``end_id`` if given; null is empty."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace"))
            size += len(group[-1])
            if size > GROUP_BYTES:
                yield from self._group(group, end_id)
                group, size = [], 0
        yield from self._group(group, end_id)

    def _group(self, group: list[bytes], end_id: int | None) -> Iterator[memoryview]:
        """Each different word of the texts is looked up once; its ids are then copied
        to all its places, and an end is one more word after each text."""
        if not group:
            return
        special = {i: self._exact(raw.decode("utf-8", "replace")) for i, raw in enumerate(group) if b"<|" in raw}
        plain = [b"" if i in special else raw for i, raw in enumerate(group)]
        joined = _lowered(b"\n".join(plain) + b"\n")
        bounds = np.cumsum([0, *map(len, plain)]) + np.arange(len(plain) + 1)
        listed, numbers, lengths = numbered_words(joined, bounds, _final_punctuation(joined))
        words = listed.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > MOST_WORDS:
            here = set(words)
            self.words = {w: ids for w, ids in self.words.items() if w in here}
        ids = list(map(self.words.get, words))
        missing = [i for i, known in enumerate(ids) if known is None]
        self._learn([words[i] for i in missing])
        for i in missing:
            ids[i] = self.words[words[i]]
        closing = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        ids = [closing, *ids]
        stops = np.cumsum(lengths)
        if closing:
            numbers, stops = np.insert(numbers, stops, 0), stops + np.arange(1, len(stops) + 1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts, each = np.cumsum(sizes) - sizes, sizes[numbers]
        ends = np.append(0, np.cumsum(each))
        places = np.repeat(firsts[numbers] - ends[:-1], each)
        places += np.arange(len(places))
        view = memoryview(np.frombuffer(b"".join(ids), "<u4")[places]).cast("B")
        bounds = (4 * ends[np.append(0, stops)]).tolist()
        for i, (start, stop) in enumerate(zip(bounds, bounds[1:])):
            yield memoryview(special[i] + closing) if i in special else view[start:stop]


_KNOWN: dict[str | None, WordIds] = {}


def word_ids(path: str | None = None) -> WordIds:
    """The encoder of this Python worker, kept with its words for the next tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]
