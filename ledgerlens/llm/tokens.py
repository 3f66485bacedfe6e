"""Token ids of whole texts, encoded by a public tokenizer once for each distinct piece between white space."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White_Space of the Unicode standard (fixed values): what \s means in both tokenizers' patterns.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Between Latin letters and ASCII punctuation (but the apostrophe, which starts contractions) both patterns always cut.
_LETTERS, _MARKS = r"A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_SURE = f"[{_LETTERS}]+(?=[{_WS}{_MARKS}]|$)|[{_MARKS}]+(?=[{_WS}{_LETTERS}]|$)"
# Byte-level pattern: a piece takes one space before it; a longer run keeps all but its last character apart.
_KEEPS_SPACE = re.compile(f" ?(?:{_SURE}|[^{_WS}]+)|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# Word-level pattern: white space is dropped.
_DROPS_SPACE = re.compile(f"{_SURE}|[^{_WS}]+")
_BLANK = re.compile(f"[{_WS}]")
# Words of these letters are one piece in both patterns; no normaliser joins, splits or reorders them, it may lower them.
_LETTERS_ONLY = re.compile(f"[{_LETTERS}]+")

# White space at an end, or a space next to other white space: such a text is cut by the pattern, any other at its spaces.
_RE2_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"\A{_RE2_WS}|{_RE2_WS}\z|{_RE2_WS} | {_RE2_WS}"
# A mark after a letter, and a line end before one: cut first, so that a word is one key whatever follows it.
_RE2_MARK = rf"([{_LETTERS}])([{_MARKS}])"
_RE2_LINE = r"([^" + _RE2_WS[1:-1] + r"])\n([" + _LETTERS + r"])"
#: Words that a worker remembers, and the longest of them: some 220 bytes each with their ids, 800 at most.
MOST_KNOWN, LONGEST_KNOWN = 280_000, 60
#: Bytes of text that are encoded at a time.
ENCODED_BYTES = 4 << 20


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Codec:
    """Exactly the ids of `tokenizer.encode(text, add_special_tokens=False)`, as little-endian unsigned 32-bit bytes.

    No token of these vocabularies spans white space (other than one leading space), or a letter and punctuation, so a
    text may be cut there. A chunk's distinct words are looked up once; those not known are cut into pieces, and all
    their new pieces are encoded as one text with a mark between them. Beyond `MOST_KNOWN` remembered words only
    those of the chunk at hand are kept, and long ones never are, so memory is bounded. Strings of special tokens inside
    a text are ordinary text.

    A key stands for a word or piece with one space before it; without one it has a line end in front. Pieces of Latin
    letters alone, nearly all, need no pattern: the same model cuts their text at spaces, and its ids say where words meet.
    """

    def __init__(self, path: str, max_known: int = MOST_KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.keeps_space = self.tokenizer.normalizer is None
        self.pattern = _KEEPS_SPACE if self.keeps_space else _DROPS_SPACE
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.most, self.known = max_known, {}
        # Between pieces that are encoded as one text: what is never joined with its neighbours, and its ids.
        self.mark, self.between = ("\n", "\n") if self.keeps_space else ("\xa4", " \xa4 ")
        self.mark_ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.words, self.at_edge = self._of_words(path)

    def _of_words(self, path: str):
        """The tokenizer for words of Latin letters between spaces, and which ids begin (or, without spaces, end) a word."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        words = Tokenizer.from_file(path)
        words.encode_special_tokens = True
        words.no_truncation()
        words.normalizer = normalizers.Sequence([])
        cut = pre_tokenizers.Split(" ", "merged_with_next" if self.keeps_space else "removed")
        words.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        at_edge = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            at_edge[i] = token.startswith("\u0120") if self.keeps_space else token.endswith("</w>")
        return words, at_edge

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, each with a space before it if the pattern keeps spaces."""
        text = " ".join(words)
        text = " " + text if self.keeps_space else text.lower()
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.at_edge[ids]) * 4
        begins = cuts.tolist() if self.keeps_space else [0, *(cuts[:-1] + 4).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(begins, [*begins[1:], len(data)], strict=True)]

    def _pieces_of(self, key: str) -> list[str]:
        """Keys of the pieces of a word that is not letters alone."""
        if not self.keeps_space:
            return self.pattern.findall(key)
        return self._keys(key[1:] if key[:1] == "\n" else " " + key)

    def _encode_pieces(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        rest, words = [], []
        for x in keys:
            (words if x.isalpha() and (x.isascii() or _LETTERS_ONLY.fullmatch(x)) else rest).append(x)
        met = dict(zip(words, self._encode_words(words), strict=True)) if words else {}
        return met | dict(zip(rest, self._encode_others(rest), strict=True))

    def _encode_others(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces, all encoded as one text but for those that are white space or hold the separator."""
        plain = [x[1:] if x[:1] == "\n" else " " + x for x in keys] if self.keeps_space else keys
        odd = [i for i, x in enumerate(plain) if _BLANK.search(x, 1) or self.mark in x or not x.strip()]
        if odd:
            found = self.tokenizer.encode_batch_fast([plain[i] for i in odd], add_special_tokens=False)
            apart = {i: np.array(x.ids, "<u4").tobytes() for i, x in zip(odd, found, strict=True)}
            plain = [x for i, x in enumerate(plain) if i not in apart]
        out = []
        if plain:
            found = self.tokenizer.encode_batch_fast([self.between.join(plain)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            gone = ids == self.mark_ids[0]
            for k, x in enumerate(self.mark_ids[1:], 1):
                gone[:-k] &= ids[k:] == x
            cuts = np.flatnonzero(gone)
            data, n = ids.tobytes(), 4 * len(self.mark_ids)
            begins = [0, *(cuts * 4 + n).tolist()]
            out = [data[a:b] for a, b in zip(begins, [*(cuts * 4).tolist(), len(data)], strict=True)]
        if odd:
            rest = iter(out)
            out = [apart[i] if i in apart else next(rest) for i in range(len(keys))]
        return out

    def _look_up(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys."""
        known = self.known
        out = list(map(known.get, keys))
        if len(known) > self.most:
            self.known = known = {x: ids for x, ids in zip(keys, out, strict=True) if ids is not None}
        fresh = [i for i, x in enumerate(out) if x is None]
        if not fresh:
            return out
        words = [keys[i] for i in fresh]
        parts = {x: self._pieces_of(x) for x in words if not x.isalpha()}
        pieces = set(words).difference(parts).union(*parts.values())
        new = list(pieces.difference(known))
        met = self._encode_pieces(new)
        for x, of in parts.items():
            met[x] = b"".join([met[y] if y in met else known[y] for y in of])
        for i, x in zip(fresh, words, strict=True):
            out[i] = met[x]
        if max(map(len, met)) > LONGEST_KNOWN:
            met = {x: ids for x, ids in met.items() if len(x) <= LONGEST_KNOWN}
        known.update(met)
        return out

    def _keys(self, text: str) -> list[str]:
        return [x[1:] if x[0] == " " and x[1:2] not in ("", "\n") else "\n" + x for x in self.pattern.findall(text)]

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Texts with a space at some places where the pattern cuts; as in keys, a line end says that no space was there.

        Where spaces count, the texts have no space next to other white space.
        """
        if not self.keeps_space:
            return pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _RE2_MARK, r"\1 \2")
        marked = pc.replace_substring_regex(texts, _RE2_MARK, "\\1 \n\\2")
        return pc.replace_substring_regex(marked, _RE2_LINE, "\\1 \n\n \n\\2")

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array without nulls."""
        if not len(texts):
            return []
        odd = {}
        if self.keeps_space:
            is_odd = pc.match_substring_regex(texts, _ODD)
            odd = {i: self._keys(texts[i].as_py()) for i in np.flatnonzero(is_odd.to_numpy(zero_copy_only=False)).tolist()}
            if odd:
                texts = pc.if_else(is_odd, "", texts)
        lists = pc.split_pattern(self._cut(texts), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values[bounds[0]:bounds[-1]].dictionary_encode()
        bounds = bounds - bounds[0]
        places, keys = coded.indices.to_numpy().astype(np.int64), _strings(coded.dictionary)
        if self.keeps_space:
            # The first word of a text has no space before it.
            at = bounds[:-1]
            starts = pa.DictionaryArray.from_arrays(pa.array(places[at], pa.int32()), coded.dictionary).dictionary_decode().dictionary_encode()
            places[at] = len(keys) + starts.indices.to_numpy()
            keys += ["\n" + x for x in _strings(starts.dictionary)]
            index = {x: i for i, x in enumerate(keys[-len(starts.dictionary):], len(keys) - len(starts.dictionary))}
            more = {}
            for i, pieces in odd.items():
                more[i] = [index.setdefault(x, len(index) + len(coded.dictionary)) for x in pieces]
            keys = keys[:len(coded.dictionary)] + list(index)
            if more:
                counts = np.diff(bounds)
                parts = np.split(places, bounds[1:-1])
                for i, x in more.items():
                    parts[i], counts[i] = np.array(x, np.int64), len(x)
                places, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))
        values = self._look_up(keys)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        pool, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[places]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = pool[np.repeat(first[places] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts, data = (ends[bounds] * 4).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Codec(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
