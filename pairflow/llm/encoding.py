"""Whole-text token ids by the tokenizers library: each distinct piece of a batch is encoded once and remembered for a while."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, the latest half and the one before it; a few hundred MB at most.
MEMO = 800_000
#: White space other than blanks and line feeds, by any rule that a tokenizer may follow.
_ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters that are letters by any version of the rules, and what may end a word.
_LETTERS = re.compile(r"[ \n]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
_LETTER_LAST = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]$"
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies; a tab parts words, a line feed is a word of its own."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*own}))}
    return table | {9: "\t", 10: table[10] + "\t"}


_ALPHABET = _alphabet()


def _strings(values: pa.Array) -> list[str]:
    """The values as a list; to_pylist takes several times as long."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts as unsigned 32-bit integers.

    Tokenizers cut a text into pieces before they merge, and pieces don't see each other. For byte-level vocabularies there
    is such a border in front of a single blank between two characters that aren't white space, and
    around a single line feed between such; for vocabularies that drop white space at every blank and line feed. Texts
    with any other white space are encoded whole. Byte-level ones also have a border between a letter and the signs after it;
    a run of letters, with its blank, is one piece to them, so the vocabulary's model gets it in their alphabet without the rules that cut.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str, limit: int = MEMO):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_space = not self._ids(" ")
        self.mark = " 0 " if self.drops_space else "\n"
        self.mark_id = self._ids(self.mark)[0]
        self.model, self.sizes = self._model(path)
        self.memo: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.limit = limit

    @classmethod
    def at(cls, path: str, limit: int = MEMO) -> Encoder:
        """One encoder for each file in a worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        cls._loaded[path].limit = limit
        return cls._loaded[path]

    def _model(self, path: str):
        """The vocabulary's model alone for words parted by tabs, and each id's number of bytes; nothing if the file has rules
        that could cut, change or join runs of letters."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = spec["pre_tokenizer"] or {}
        usual = rules.get("type") == "ByteLevel" and rules.get("use_regex", True) and not rules.get("add_prefix_space")
        if not usual or spec["normalizer"] or spec["model"].get("dropout") or not all(t["special"] for t in spec["added_tokens"]):
            return None, None
        model = Tokenizer(self.tokenizer.model)
        model.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        sizes[list(vocab.values())] = list(map(len, vocab))
        return model, sizes

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        return np.array(self._ids(text), np.uint32).tobytes()

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of runs of letters, each with its blank or line feed: many in one text, cut where the ids' bytes add up to the pieces'."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 2000):
            some = pieces[i : i + 2000]
            text = "\t".join(some).encode()
            ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 9), len(text)) - np.arange(len(some))
            ids = np.array(self.model.encode_batch_fast([text.decode("latin-1").translate(_ALPHABET)], add_special_tokens=False)[0].ids, np.uint32)
            read = np.append(0, np.cumsum(self.sizes[ids]))
            cuts = np.searchsorted(read, ends)
            if read[-1] != ends[-1] or (read[cuts] != ends).any():  # the vocabulary lacks a byte
                out += map(self._raw, some)
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            out += map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))
        return out

    def _learnt(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: runs of letters by the model alone, the others by the whole tokenizer."""
        if self.model and (runs := [p for p in pieces if _LETTERS(p)]):
            known = dict(zip(runs, self._letters(runs), strict=True))
            others = [p for p in pieces if p not in known]
            known.update(zip(others, self._parted(others), strict=True))
            return [known[p] for p in pieces]
        return self._parted(pieces)

    def _parted(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: many in one text, parted by a mark that is a piece of its own and in none of them but at the front."""
        bare = self.mark.strip() or self.mark
        out: list[bytes] = []
        for i in range(0, len(pieces), 2000):
            some = pieces[i : i + 2000]
            rest = [p.removeprefix(self.mark) for p in some]
            plain = [p for p in rest if p and bare not in p]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(plain)], add_special_tokens=False)[0].ids, np.uint32) if plain else np.empty(0, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if plain and len(cuts) != len(plain) - 1:
                out += map(self._raw, some)
                continue
            raw = ids.tobytes()
            parts = iter(map(raw.__getitem__, map(slice, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)])))
            front = np.array([self.mark_id], np.uint32).tobytes()
            out += [(next(parts) if p is q or p == q else front + next(parts)) if p and bare not in p else self._raw(q) for p, q in zip(rest, some, strict=True)]
        return out

    def _of(self, pieces: list[str], blank: str = "") -> list[bytes]:
        """Ids of pieces, each of which stands after ``blank`` (but for those that begin with a line feed)."""
        memo, older = (self.memo, self.older[0]) if blank else (self.first, self.older[1])
        found = list(map(memo.get, pieces))
        at = [i for i, f in enumerate(found) if f is None]
        if not at:
            return found
        lost = [pieces[i] for i in at]
        kept = list(map(older.get, lost))
        new = list(dict.fromkeys(p for p, k in zip(lost, kept, strict=True) if k is None))
        memo.update(zip(lost, kept, strict=True))
        if new:
            full = [p if p[:1] == "\n" else blank + p for p in new] if blank else new
            memo.update(zip(new, self._learnt(full), strict=True))
        for i, p in zip(at, lost, strict=True):
            found[i] = memo[p]
        return found

    def _words(self, values: pa.Array) -> pa.Array:
        """Ids of pieces after a blank. Words are remembered without the signs that follow their last letter."""
        if not self.model:
            return pa.array(self._of(_strings(values), " "), pa.large_binary())
        bare = pc.utf8_rtrim(values, characters=_SIGNS)
        ends = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(values)), pc.match_substring_regex(bare, _LETTER_LAST))
        words = pc.if_else(ends, bare, values).dictionary_encode()
        known = pa.array(self._of(_strings(words.dictionary), " "), pa.large_binary()).take(words.indices)
        at = np.flatnonzero(ends.to_numpy(zero_copy_only=False))
        if not len(at):
            return known
        longer, shorter = (_strings(x.take(pa.array(at))) for x in (values, bare))
        signs = pa.array([v[len(b) :] for v, b in zip(longer, shorter, strict=True)]).dictionary_encode()
        which = np.full(len(values), len(signs.dictionary))
        which[at] = signs.indices
        after = pa.array([*self._of(_strings(signs.dictionary)), b""], pa.large_binary()).take(pa.array(which))
        return pc.binary_join_element_wise(known, after, pa.scalar(b"", pa.large_binary()))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a blank; no word is empty or has white space. Words stay remembered until :meth:`forget`."""
        return _strings(self._words(pa.array(words, pa.string())))

    def forget(self) -> None:
        self.memo, self.first, self.older = {}, {}, ({}, {})

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (each followed by ``end``), and the texts' borders in them. Null texts are empty."""
        if len(self.memo) + len(self.first) > self.limit // 2:
            self.older, self.memo, self.first = (self.memo, self.first), {}, {}
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = np.zeros(n, bool)
        if self.drops_space:
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            odd = pc.match_substring_regex(texts, _ODD + r"|  | \n|\n |\n\n|^ | $|^\n|\n$")
            whole = np.asarray(odd.to_numpy(zero_copy_only=False), bool)
            parts = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        borders = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.drops_space:
            known = [pa.array(self._of(_strings(coded.dictionary)), pa.large_binary())]
        else:
            n_known = len(coded.dictionary)
            first = self._of(_strings(coded.dictionary.take(pa.array(codes[borders[:-1]]))))  # no blank in front
            for i in np.flatnonzero(whole).tolist():
                first[i] = self._raw(texts[i].as_py())
            known = [self._words(coded.dictionary), pa.array(first, pa.large_binary())]
            codes[borders[:-1]] = n_known + np.arange(n)
        if end is not None:  # a last piece for each text
            codes = np.insert(codes, borders[1:], sum(map(len, known)))
            borders = borders + np.arange(n + 1)
            known.append(pa.array([np.array([end], np.uint32).tobytes()], pa.large_binary()))
        flat = pa.concat_arrays(known).take(pa.array(codes))
        _, ends, raw = flat.buffers()
        ends = np.frombuffer(ends, np.int64, len(flat) + 1) // 4
        ids = np.frombuffer(raw or b"", np.uint32, ends[-1])
        return ids, ends[borders]
