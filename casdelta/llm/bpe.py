"""BPE encoding and decoding with a public vocabulary, sharing the work of common prefixes.

A word's byte-pair encoding has a prefix property: dropping the last token of the encoding of a prefix leaves the encoding of a
shorter prefix. So it is enough to keep, for every prefix, its last token and the prefix before that token. The distinct words of a
batch, sorted, are a trie in preorder: the prefix that a word shares with the one before it is the path the two have in common. The
trie is walked depth first with the states of the current path on a stack, so each edge is visited once and no node is kept when its
branch is done. A new node takes the longest token that ends there and that is compatible with the last token of the prefix before
it: byte-pair merging of the two, joined, never merges across the seam.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from casdelta.llm.common import slices

#: White space by Unicode's property, as the vocabulary's normaliser understands \s.
SPACE = "\t-\r \x85\xa0  -     　"

# Letters and digits of Unicode 16, and lower case of Unicode 17, that this interpreter's tables may not have yet.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 "
    "113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
)
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


@lru_cache(maxsize=2)
def category(first: str, more: str) -> str:
    """The inside of a character class: all characters whose general category begins so, and the ranges of `more`."""
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == first]
    codes += [c for r in more.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[1], 16) + 1)]
    out: list[list[int]] = []
    for c in sorted(set(codes)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters, digits = category("L", NEW_LETTERS), category("N", NEW_DIGITS)
        self.words = re.compile(split["pattern"]["Regex"].replace(r"\s", SPACE).replace(r"[\p{N}]", r"\p{N}").replace(r"\p{L}", letters).replace(r"|\p{N}", f"|[{digits}]").replace(r"\p{N}", digits))
        self.text = {i: t for t, i in (self.ids | self.special).items()}
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(self.suffix)}
        self.last = {t.removesuffix(self.suffix): i for t, i in self.ids.items() if t.endswith(self.suffix)}
        #: of each three last symbols, the most symbols of a token that ends so
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for reach, table in zip(self.reach, (self.inner, self.last), strict=True):
            for t in table:
                reach[t[-3:]] = max(len(t), reach.get(t[-3:], 0))
        #: token pairs, packed into one number, to the rank of their merge; the parts of each merged token
        self.pairs: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for (x, y), rank in self.rank.items():
            left, right = self.ids[x], self.ids[y]
            self.pairs[left << 20 | right] = rank
            self.parts[self.ids[x + y]] = (left, right)

    def symbols(self, token: int) -> list[str]:
        t = self.text[token]
        body = t.removesuffix(self.suffix)
        out = list(body)
        if body != t:
            out[-1] += self.suffix
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Plain byte-pair merging: the leftmost pair of least rank, again and again."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class PrefixTrie:
    """Encodings of sorted words by a depth-first walk over their trie; remembers which tokens may stand side by side."""

    def __init__(self, vocab: Vocabulary, most: int = 250_000):
        self.vocab, self.most = vocab, most
        self.fits: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})

    def alone(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token back."""
        known = self.sound.get(token)
        if known is None:
            v = self.vocab
            known = self.sound[token] = v.merge(v.symbols(token)) == [v.text[token]]
        return known

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (0 left, 1 right) while the token is merged, each with the rank at which it is merged on."""
        known = self.edges[side].get(token)
        if known is None:
            known, now, until = [], token, 1 << 60
            while True:
                known.append((now, until))
                parts = self.vocab.parts.get(now)
                if parts is None:
                    break
                until, now = self.vocab.pairs[parts[0] << 20 | parts[1]], parts[side]
            self.edges[side][token] = known
        return known

    def seam(self, left: int, right: int) -> bool:
        """Whether no merge crosses the seam: a pair across it merges if its rank comes before that of both sides' own next merge.

        At equal ranks the merge further left goes first.
        """
        pairs = self.vocab.pairs
        for x, x_until in self.edge(left, 1):
            for y, y_until in self.edge(right, 0):
                rank = pairs.get(x << 20 | y)
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side; left -1: nothing stands before."""
        pair = left << 20 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > self.most:
                self.fits.clear()
            known = self.fits[pair] = self.alone(right) and (left < 0 or self.seam(left, right))
        return known

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """Tokens of each of the words, whose bytes stand as symbols; they must be sorted and not empty."""
        v, fits = self.vocab, self.fits.get
        token, begin, before = [-1], [0], ""
        for word in words:
            n, shared = len(word), 0
            most = min(len(token), n) - 1  # a word's last symbol is another one than within a word
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del token[shared + 1 :], begin[shared + 1 :]
            table, reach = v.inner.get, v.reach[0].get
            for depth in range(shared + 1, n + 1):
                if depth == n:
                    table, reach = v.last.get, v.reach[1].get
                for start in range(max(0, depth - reach(word[max(0, depth - 3) : depth], 2)), depth):
                    found = table(word[start:depth])
                    if found is not None:
                        left = token[start]
                        known = fits(left << 20 | found)
                        if known or (known is None and self.compatible(left, found)):
                            break
                else:
                    raise ValueError(f"the vocabulary has no token for {word[depth - 1]!r}")
                token.append(found)
                begin.append(start)
            out = [token.pop()]
            at = begin.pop()
            while at:
                out.append(token[at])
                at = begin[at]
            yield tuple(out[::-1])
            before = word


class Encoder:
    """Encodes and decodes whole texts; remembers the tokens of pieces between white space, up to max_pieces of them.

    A piece is known by a number, its tokens lie in one flat array, so a batch is put together by numpy and Arrow.
    """

    def __init__(self, path: str, max_pieces: int = 350_000):
        self.vocab = Vocabulary(path)
        self.trie = PrefixTrie(self.vocab)
        self.max_pieces = max_pieces
        self.byte = dict(enumerate(byte_symbols()))
        self.space = re.compile(f"[{SPACE}]+")
        self.marks = ".,;:!?*#%$&-)]"
        self.odd = re.compile("[\x1c-\x1f]")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.vocab.special)) + ")") if self.vocab.special else None
        self.names = pa.array([self.vocab.text.get(i) for i in range(max(self.vocab.text) + 1)], pa.string())
        #: piece to number; a special token's key is a tuple, which no piece is
        self.pieces: dict[str | tuple[str], int] = {}
        self.flat, self.ends, self.met = array("i"), array("q", [0]), np.zeros(0, np.int64)
        self.remember({(t,): (i,) for t, i in self.vocab.special.items()})

    def remember(self, coded: dict) -> None:
        self.pieces.update(zip(coded, range(len(self.pieces), len(self.pieces) + len(coded)), strict=True))
        self.flat.extend(chain.from_iterable(coded.values()))
        last = self.ends[-1]
        self.ends.extend((np.cumsum(np.fromiter(map(len, coded.values()), np.int64, len(coded))) + last).tolist())
        self.met = np.append(self.met, np.zeros(len(coded), np.int64))

    def forget(self) -> None:
        """Keep the special tokens and what more than one batch had, if that is under half of what may be kept."""
        known = [p for p, n in zip(self.pieces, self.met.tolist(), strict=True) if n > 1 or isinstance(p, tuple)]
        if len(known) > self.max_pieces // 2:
            known = [p for p in known if isinstance(p, tuple)]
        kept = {p: tuple(self.flat[self.ends[self.pieces[p]] : self.ends[self.pieces[p] + 1]]) for p in known}
        self.pieces, self.flat, self.ends, self.met = {}, array("i"), array("q", [0]), np.zeros(0, np.int64)
        self.remember(kept)

    def lower(self, s: str) -> str:
        """Lower case character by character: a final sigma is as any other."""
        return s.lower() if max(s, default="") < "\u0370" else s.translate(NEW_LOWER).replace("Σ", "σ").lower()

    def words(self, piece: str) -> list[str]:
        """The words of a piece, their bytes as symbols; printable ASCII stands for itself."""
        if piece.isascii() and piece.isprintable():
            low = piece.lower()
            body = low.rstrip(self.marks)
            if body.isalpha():  # the usual case: letters, and a run of other marks behind
                return [body] if body == low else [body, low[len(body) :]]
            return self.vocab.words.findall(low)
        found = self.vocab.words.findall(self.lower(unicodedata.normalize("NFC", piece)))
        return [w.encode("utf-8").decode("latin-1").translate(self.byte) for w in found]

    def split(self, text: str | None) -> list:
        """Keys of the text's pieces and special tokens, in order."""
        if not text:
            return []
        if self.cut is not None and "<" in text and len(parts := self.cut.split(text)) > 1:
            return list(chain.from_iterable([(p,)] if i % 2 else self.split(p) for i, p in enumerate(parts)))
        if self.odd.search(text):
            return [p for p in self.space.split(text) if p]
        return text.split()

    def learn(self, pieces: set) -> None:
        """Take the distinct pieces' words through the trie, sorted."""
        words = {p: self.words(p) for p in pieces}
        sorted_words = sorted(set(chain.from_iterable(words.values())))
        coded = dict(zip(sorted_words, self.trie.encode_sorted(sorted_words), strict=True))
        self.remember({p: coded[of[0]] if len(of) == 1 else tuple(chain.from_iterable(map(coded.__getitem__, of))) for p, of in words.items()})

    def both(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.Array]:
        """Token ids of each text, and what they decode to: the tokens' strings joined by one space, as the file names no decoder."""
        split = [self.split(t) for t in texts]
        keys = list(chain.from_iterable(split))
        if len(self.pieces) > self.max_pieces:
            self.forget()
        number = np.fromiter(map(self.pieces.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.nonzero(number < 0)[0]):
            self.learn({keys[i] for i in new})
            number[new] = np.fromiter((self.pieces[keys[i]] for i in new), np.int64, len(new))
        self.met += np.bincount(number, minlength=len(self.met)) > 0
        ends = np.asarray(self.ends)
        first, size = ends[number], ends[number + 1] - ends[number]
        before = np.cumsum(size) - size
        at = np.repeat(first - before, size) + np.arange(int(size.sum()))
        flat = np.asarray(self.flat)[at] if len(at) else np.empty(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, split)])]
        bounds = pa.array(bounds.astype(np.int32))
        strings = pa.ListArray.from_arrays(bounds, self.names.take(pa.array(flat)))
        return pa.ListArray.from_arrays(bounds, pa.array(flat, pa.int32())), pc.binary_join(strings, " ")

    def encode(self, text: str | None) -> list[int]:
        return self.both([text])[0][0].as_py()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.vocab.text.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker, so that what it has learned serves its later tasks."""
    return Encoder(path)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return (id_col, ids array<int>, decoded string), a row for each row of docs.

    vocabulary: path of the vocabulary file on every executor. A null or empty text has no ids and decodes to ''; null ids of rows,
    repeated rows and other columns make no difference. Texts are whole however long; they are worked on some thousand or some million
    bytes at a time, and what is remembered is emptied when full. No row depends on another, so any task can run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, 1, 4000, 3 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), *enc.both(part.column(1).to_pylist())], ["id", "ids", "decoded"])

    out = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
