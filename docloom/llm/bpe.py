"""BPE encoding and decoding by prefix-sharing trie traversal (operator 2).

A text's words are found as the tokenizer's own rules say; distinct words are encoded once. New
words of a batch form a trie, whose depth-first traversal keeps, for every prefix on the path,
the last token of that prefix's encoding: the one token that ends there and stays unmerged with
the last token before it. A word's ids are read backwards along these states, so prefixes that
words share are encoded once. Decoding looks up each id's token string and joins them by one space.

Texts whose characters, and their lower case, lie below U+0250 take a fast path: their words are found, told apart and
turned into ids as arrays, many texts at once. Others are normalised and split by the tokenizers library's own components.
Special tokens' strings in a text become their ids.

Defined results: null counts as empty; an empty text has no ids and decodes to an empty text.
Any length is handled; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import map_texts

#: Words of a worker's store after which it starts a new generation; the generation before is kept beside it.
CACHE_WORDS = 300_000
#: Characters of texts whose words are looked up together; a longer text on the fast path is cut at white space.
BATCH_CHARS = 1 << 20
_FAST = 0x250
#: Kinds of characters on the fast path (white space is 0), and what stands in for those that are not on it.
LETTER, NUMBER, OTHER, HIGH = 1, 2, 3, 0xFFFF
#: Last characters by which the longest token that can end there is looked up.
TAIL = 4


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else 256 onwards in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """The word-level BPE of one tokenizer file."""

    def __init__(self, path: str, by_library: bool = False):
        from tokenizers import Tokenizer

        self.by_library = by_library
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.vocab[a + b]
            self.split[whole] = (self.vocab[a], self.vocab[b])
            self.rank[whole] = r
            self.merged[self.split[whole]] = r
        self.shown = byte_alphabet()
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        classes = {"L": "", "N": ""}
        for c in map(chr, range(_FAST)):
            kind = unicodedata.category(c)[0]
            if kind in classes:
                classes[kind] += re.escape(c)
        space = r"\t-\r \x85\xa0"
        self.fast = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{classes['L']}]+|[{classes['N']}]|[^{space}{classes['L']}{classes['N']}]+")
        grown = "".join(c for c in map(chr, range(_FAST)) if max(c.lower()) >= chr(_FAST))  # lower case leaves the fast path's characters
        self.slow = re.compile(f"[^\x00-{chr(_FAST - 1)}]|[{grown}]")
        self.lower = np.full(1 << 16, HIGH, np.uint16)
        self.kind = np.full(_FAST, OTHER, np.uint8)
        for c in map(chr, range(_FAST)):
            if c not in grown:
                self.lower[ord(c)] = ord(c.lower())
            if c in "\t\n\v\f\r \x85\xa0":
                self.kind[ord(c)] = 0
            elif (initial := unicodedata.category(c)[0]) in "LN":
                self.kind[ord(c)] = LETTER if initial == "L" else NUMBER
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        #: Tokens inside and at the end of a word, by their characters; the longest of them by its last TAIL characters.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, i in self.vocab.items():
            if self.is_whole(i):
                known, t = (self.final, t.removesuffix(self.suffix)) if t.endswith(self.suffix) else (self.inner, t)
                known[t] = i
        self.size = {i: len(t) for known in (self.inner, self.final) for t, i in known.items()}
        self.longest = max(self.size.values())
        self.inner_reach, self.final_reach = self._reach(self.inner), self._reach(self.final)
        self.tokens = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.ids: dict = {}
        self.old: dict = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b, next to each other, stay as they are: no merge across their border comes first."""
        known = self._fits.get((a, b))
        if known is not None:
            return known
        x, y, until_x, until_y, good = a, b, 1 << 60, 1 << 60, True
        while True:
            r = self.merged.get((x, y))
            if r is not None and r < until_x and r <= until_y:
                good = False
                break
            made_x, made_y = self.rank.get(x, -1), self.rank.get(y, -1)
            if made_x < 0 and made_y < 0:
                break
            if made_y >= made_x:  # the later made of the two comes apart first, of equals the right one
                until_y, y = made_y, self.split[y][0]
            else:
                until_x, x = made_x, self.split[x][1]
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        self._fits[(a, b)] = good
        return good

    def is_whole(self, token: int) -> bool:
        """Whether a token's own string is encoded as that token."""
        if token not in self.split:
            return True
        known = self._whole.get(token)
        if known is None:
            a, b = self.split[token]
            known = self._whole[token] = self.is_whole(a) and self.is_whole(b) and self._joins(token)
        return known

    def _joins(self, token: int) -> bool:
        """fits() of the two parts, but for their own merge at the end."""
        (a, b), r = self.split[token], self.rank[token]
        x, y, until_x, until_y = a, b, r, r
        first = True
        while True:
            m = self.merged.get((x, y))
            if not first and m is not None and m < until_x and m <= until_y:
                return False
            first = False
            made_x, made_y = self.rank.get(x, -1), self.rank.get(y, -1)
            if made_x < 0 and made_y < 0:
                return True
            if made_y >= made_x:
                until_y, y = made_y, self.split[y][0]
            else:
                until_x, x = made_x, self.split[x][1]

    @staticmethod
    def _reach(known: dict[str, int]) -> dict[str, int]:
        out: dict[str, int] = {}
        for t in known:
            if len(t) >= TAIL:
                out[t[-TAIL:]] = max(out.get(t[-TAIL:], 0), len(t))
        return out

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of each word in the byte alphabet.

        In sorted order the words are the leaves of their trie as a depth-first traversal meets them: what
        a word shares with the one before it is the part of the path that stays, with its states.
        """
        out: dict[str, list[int]] = {}
        tokens = [0]  # tokens[d]: last token of the path's first d characters, as inner part of a word
        size, last, before = self.size, self._last, ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before), len(tokens) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del tokens[shared + 1 :]
            n = len(word)
            for depth in range(shared + 1, n):
                tokens.append(last(word, depth, self.inner, self.inner_reach, tokens))
            token = last(word, n, self.final, self.final_reach, tokens)
            ids, at = [token], n - size[token]
            while at:
                token = tokens[at]
                ids.append(token)
                at -= size[token]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def _last(self, path: str, depth: int, known: dict[str, int], reach: dict[str, int], tokens: list[int]) -> int:
        """The one known token that ends the first depth characters of path and stays unmerged with the last token before it."""
        fits = self._fits
        for k in range(min(depth, reach.get(path[max(depth - TAIL, 0) : depth], TAIL - 1)), 0, -1):
            token = known.get(path[depth - k : depth])
            if token is not None:
                if k == depth:
                    return token
                pair = (tokens[depth - k], token)
                good = fits.get(pair)
                if good is None:
                    good = self.fits(*pair)
                if good:
                    return token
        raise ValueError(f"no token ends {path[:depth]!r}")

    def _pieces(self, text: str) -> list:
        """Keys of the text's words: the words themselves on the fast path, else (word in the byte alphabet,) or (special token's id,)."""
        if self.cut is None or "<|" not in text:
            segments = [text]
        else:
            segments = self.cut.split(text)
        out: list = []
        for i, segment in enumerate(segments):
            if i % 2:
                out.append((self.special[segment],))
            elif self.slow.search(segment):
                out += [(w,) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))]
            else:
                out += self.fast.findall(segment.lower())
        return out

    def _learn(self, new: list) -> None:
        mapped: dict = {}
        for key in new:
            if isinstance(key, str):
                # printable ASCII stands for itself
                mapped[key] = key if key.isascii() and key.isprintable() else "".join([self.shown[b] for b in key.encode()])
            elif isinstance(key[0], str):
                mapped[key] = key[0]
            else:
                self.ids[key] = key[0].to_bytes(4, "little")
        if self.by_library:
            tokenize = self.library.model.tokenize
            for key, word in mapped.items():
                self.ids[key] = array("I", [t.id for t in tokenize(word)]).tobytes()
        else:
            encoded = self.encode_words(set(mapped.values()))
            for key, word in mapped.items():
                self.ids[key] = array("I", encoded[word]).tobytes()

    def _known(self, keys: list) -> list[bytes]:
        """The ids of each of the keys, which are distinct, by the store, which learns what it lacks.

        A full store starts a new generation; words of the old one come along when needed.
        """
        if len(self.ids) > CACHE_WORDS:
            self.old, self.ids = self.ids, {}
        found = list(map(self.ids.get, keys))
        lacking = [i for i, x in enumerate(found) if x is None]
        if lacking:
            new = []
            for key in (keys[i] for i in lacking):
                x = self.old.get(key)
                if x is None:
                    new.append(key)
                else:
                    self.ids[key] = x
            self._learn(new)
            for i in lacking:
                found[i] = self.ids[keys[i]]
        return found

    def decode(self, ids: bytes) -> str:
        """The text of ids, all of them the tokenizer's, as encode_texts gives them."""
        numbers = array("I")
        numbers.frombytes(ids)
        return " ".join(map(self.tokens.__getitem__, numbers))

    def _codes(self, text: str) -> np.ndarray | None:
        """The text's characters in lower case; None off the fast path."""
        if self.cut is not None and "<|" in text:
            return None
        codes = self.lower[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")]
        return None if codes.max(initial=0) == HIGH else codes

    def _starts(self, codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Marks of the characters that start a word, as self.fast finds them; two of white space must end the codes."""
        start = kind != 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quote = np.flatnonzero(start & (codes == ord("'")))
        one, two = codes[quote + 1], codes[quote + 2]
        pair = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (one == ord(x)) & (two == ord(y))
        short = pair | np.isin(one, [ord(x) for x in "stmd"])
        quote, after = quote[short], (quote + 2 + pair)[short]
        start[quote + 1] = False
        start[after[kind[after] == LETTER]] = True
        return start

    def _encode_codes(self, texts: list[np.ndarray]) -> list[bytes]:
        """Ids of texts on the fast path: each distinct word is looked up once, and its ids copied to its places."""
        gap = np.full(1, ord(" "), np.uint16)
        codes = np.concatenate([*(x for t in texts for x in (t, gap)), gap])
        kind = self.kind[codes]
        start, inside = self._starts(codes, kind), kind != 0
        letters = codes[inside]
        first = np.append(np.flatnonzero(start[inside]), len(letters))
        if len(first) == 1:
            return [b""] * len(texts)
        words = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(2 * first), pa.py_buffer(letters)]).dictionary_encode()
        _, offsets, data = words.dictionary.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(words.dictionary) + 1, 8 * words.dictionary.offset)
        shown = data[: bounds[-1]].to_pybytes().decode("utf-16-le")
        bounds = (bounds // 2).tolist()
        keys = [shown[a:b] for a, b in zip(bounds, bounds[1:])]
        parts = self._known(keys)
        flat, sizes = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        word = words.indices.to_numpy()
        size = sizes[word]
        end = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[word] - end + size, size) + np.arange(end[-1])].tobytes()
        until = np.searchsorted(np.flatnonzero(start), np.cumsum([len(t) + 1 for t in texts]))
        cuts = [0, *np.append(0, 4 * end)[until].tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _slices(self, codes: np.ndarray) -> list[np.ndarray]:
        """A long text in parts that start at white space, of BATCH_CHARS or little more where there is any."""
        gaps = np.flatnonzero(self.kind[codes] == 0)
        near = np.searchsorted(gaps, np.arange(BATCH_CHARS, len(codes), BATCH_CHARS))
        return np.split(codes, np.unique(gaps[near[near < len(gaps)]]))

    def encode_texts(self, texts: list[str], show: bool = True) -> list[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and if show the text decoded from them."""
        out: list[tuple[bytes, str]] = []
        at = 0
        while at < len(texts):
            first, size, plain, other = at, 0, {}, {}
            while at < len(texts) and (at == first or size + len(texts[at]) <= BATCH_CHARS):
                size += len(texts[at])
                codes = self._codes(texts[at])
                if codes is None:
                    other[at] = self._pieces(texts[at])
                else:
                    plain[at] = codes
                at += 1
            done: dict[int, bytes] = {}
            if size > BATCH_CHARS and plain:  # one long text
                done[first] = b"".join([self._encode_codes([x])[0] for x in self._slices(plain[first])])
            elif plain:
                done = dict(zip(plain, self._encode_codes(list(plain.values()))))
            if other:
                keys = list(set().union(*other.values()))
                known = dict(zip(keys, self._known(keys)))
                done |= {i: b"".join(map(known.__getitem__, words)) for i, words in other.items()}
            out += [(done[i], self.decode(done[i]) if show else "") for i in range(first, at)]
        return out


@lru_cache(1)
def loaded(path: str, by_library: bool = False) -> WordBpe:
    """The tokenizer of this process; the path must exist on every machine. by_library: words are encoded by the tokenizers library."""
    return WordBpe(path, by_library)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ENCODED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digests(path: str):
    def run(texts: pa.Array) -> pa.Array:
        done = loaded(path).encode_texts([x or "" for x in texts.to_pylist()])
        columns = [pa.array([len(ids) // 4 for ids, _ in done], pa.int64())]
        columns.append(pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in done], pa.string()))
        columns.append(pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in done], pa.string()))
        return pa.StructArray.from_arrays(columns, [x.split()[0] for x in ENCODED.split(", ")])

    return run


def encode_column(path: str):
    """Column function: text to its ids (array<int>)."""

    def run(texts: pa.Array) -> pa.Array:
        done = loaded(path).encode_texts([x or "" for x in texts.to_pylist()], show=False)
        return pa.array([np.frombuffer(ids, "<u4").astype("i4") for ids, _ in done], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def decode_column(path: str):
    """Column function: ids (array<int>) to text; null counts as no ids."""

    def run(ids: pa.Array) -> pa.Array:
        token = loaded(path).token
        return pa.array([" ".join(token[i] for i in x or ()) for x in ids.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return map_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"], encode_digests(default_path()), ENCODED)
