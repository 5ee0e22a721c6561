"""Fast token ids for a word-level BPE tokenizer file: the same ids as the library, by distinct chunks.

The tokenizer's pre-tokenizer never joins across white space, so a text's ids are those of its white-space-separated
chunks one after the other. Over a group of texts each distinct chunk is encoded once, and its ids are gathered
wherever it stands. Nothing is kept between groups. Chunks are encoded together by a byte-pair encoder that merges in the file's order and in which one byte, ``END``, stands for the end of
a word. That encoder joins any two neighbours that make an entry, the library only the two its merge list names. The
two agree if each entry's own string is encoded as that entry: else its encoding would have got stuck at neighbours
that the list doesn't name. That is checked when the table is made. Texts for which the rules aren't certain (control
characters that the two regular expression dialects treat differently, special tokens' strings) go to the library whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a group, beyond which only a single text goes.
GROUP = 4 << 20
#: Ends a word in what the encoder reads; texts that hold it go to the library.
END = "\x1f"
_UNSURE = r"[\x1c-\x1f]|<\|"
#: Below U+0130 lower-casing is by character, text is composed already, and dialects agree on letters and numbers.
_ODD = r"[^\x00-\x{12f}]"
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def _alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gathered(ids: np.ndarray, first: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ids in a row, and their bounds."""
    n = counts[at]
    ends = np.concatenate(([0], np.cumsum(n)))
    return ids[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])], ends


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.exact = self._build(path)
        if self.exact:
            probe = "It's A b2b  test, (über) ééé!? élan_vital #1 it''s 'tis §±²x"
            self.exact = bool(np.array_equal(self._plain(pa.array(probe.split(), pa.large_string()))[0], self._whole(probe)))

    def _build(self, path: str) -> bool:
        """Make the encoder; whether the file is of the kind it is for."""
        import tiktoken
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, letters = model.get("end_of_word_suffix"), _alphabet()
        if model.get("type") != "BPE" or not suffix:
            return False

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + END.encode() * ends

        vocab = model["vocab"]
        merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        named = list(letters) + [c + suffix for c in letters] + ["".join(pair) for pair in merges]
        if not set(named) <= vocab.keys() or len(set(named)) != len(named):
            return False
        ranks: dict[bytes, int] = {}
        for token in named:
            ranks.setdefault(raw(token), len(ranks))
        if len(ranks) != len(named):
            return False
        self.encoder = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array([vocab[t] for t in named], dtype="<u4")
        self.ends, self.empty = np.array([raw(t).endswith(END.encode()) for t in named]), ranks[END.encode()]
        ends = [pair[1].endswith(suffix) for pair in merges]
        within = BPE(vocab=vocab, merges=[p for p, e in zip(merges, ends, strict=True) if not e])
        library = self.tokenizer.model  # adds the suffix to the last letter by itself
        return all([x.value for x in (library.tokenize(t[: -len(suffix)]) if e else within.tokenize(t))] == [t] for t, e in zip(named[len(named) - len(ends) :], ends, strict=True))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has."""
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks), _PIECE, r"\0 "))
        pieces = split.flatten().dictionary_encode()
        if not len(pieces):
            return np.zeros(0, dtype="<u4"), np.zeros(len(chunks), dtype=np.int64)
        names = pieces.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.scalar(END, pa.large_string()))[0].as_py()
        ranks = self.encoder.encode_to_numpy(joined + END, disallowed_special=())
        stops = np.flatnonzero(self.ends[ranks])
        counts = np.diff(stops, prepend=-1) - (ranks[stops] == self.empty)
        found, ends = gathered(self.ids[ranks[ranks != self.empty]], np.cumsum(counts) - counts, counts, pieces.indices.to_numpy())
        return found, np.diff(ends[np.cumsum(pc.list_value_length(split).to_numpy())], prepend=0)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each chunk's begin and how many they are."""
        odd = pc.match_substring_regex(chunks, _ODD)
        ids, some = self._plain(chunks.filter(pc.invert(odd)))
        others, odd = [self._whole(c) for c in chunks.filter(odd).to_pylist()], odd.to_numpy(zero_copy_only=False)
        counts, first = np.zeros((2, len(chunks)), dtype=np.int64)
        counts[~odd], counts[odd] = some, [len(o) for o in others]
        first[~odd] = np.cumsum(some) - some
        first[odd] = len(ids) + np.cumsum(counts[odd]) - counts[odd]
        return np.concatenate([ids, *others]), first, counts

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        if not (self.exact and texts):
            return [self._whole(t.decode()) for t in texts]
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        unsure = pc.match_substring_regex(column, _UNSURE)
        split = pc.utf8_split_whitespace(pc.if_else(unsure, "", column))
        words = split.flatten().dictionary_encode()
        found, ends = gathered(*self._distinct(words.dictionary), words.indices.to_numpy())
        borders = ends[np.cumsum(pc.list_value_length(split).to_numpy())]
        return [self._whole(t.decode()) if u else x for t, u, x in zip(texts, unsure.to_pylist(), np.split(found, borders[:-1]), strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
