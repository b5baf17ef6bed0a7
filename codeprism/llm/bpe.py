"""BPE encoding of distinct words over a shared-prefix trie, and its decoding.

A BPE encoding is the only token sequence whose neighbours stay apart when merged on
their own.  So each prefix of a word is described by its last token alone: a token t
that ends the prefix is the right one if the prefix before t ends in a token that
stays apart from t.  The distinct new words of a batch are walked in sorted order,
which is a depth-first walk of their trie; the stack holds the last-token state of
each prefix, and a prefix that many words share is settled once.

Words come from the tokenizer file's own rules: its special tokens are cut out of the
raw text, then NFC, white space and lower case, then its word pattern.  The result
per white-space chunk is kept in a dictionary of bounded size in each worker.

Edge cases: null and empty texts have no tokens; repeated rows are encoded alike; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Unicode white space, which is what the tokenizers' ``\\s`` matches.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks in each of the two generations that a worker keeps; the older one is dropped when the newer is full.
KEPT_CHUNKS = 250_000
#: Characters of text that are encoded together.
BATCH_CHARS = 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class TrieCoder:
    """Encodes words of byte symbols with the merges of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.longest = max(len(t.removesuffix(end)) for t in vocab)
        self.apart: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 40))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if len(token) > len(self.end) else token
        return list(body) if body is token or body == token else [*body[:-1], body[-1] + self.end]

    def fits(self, before: str, token: str) -> bool:
        """Whether ``token`` may follow ``before`` (empty at a word's start)."""
        known = self.apart.get((before, token))
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            want = [before, token] if before else [token]
            known = self.apart[before, token] = self.merged(self.symbols(before) * bool(before) + self.symbols(token)) == want
        return known

    def last(self, text: str, upto: int, states: list[str], end: str) -> str:
        """The token that ends ``text[:upto]`` (with ``end`` at its end); states[i]: that of text[:i]."""
        for start in range(max(0, upto - self.longest), upto):
            token = text[start:upto] + end
            if token in self.vocab and self.fits(states[start], token):
                return token
        raise ValueError(f"no encoding for {text!r}")

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of the distinct ``words`` with its tokens, in the order of the trie."""
        states, path = [""], ""
        for word in sorted(words):
            same, most = 0, min(len(path), len(word) - 1)
            while same < most and path[same] == word[same]:
                same += 1
            del states[same + 1 :]
            for i in range(same + 1, len(word)):
                states.append(self.last(word, i, states, ""))
            path = word[:-1]
            tokens = [self.last(word, len(word), states, self.end)]
            at = len(word) - len(tokens[0].removesuffix(self.end))
            while at:
                tokens.append(states[at])
                at -= len(states[at])
            yield word, tokens[::-1]


class WordBpe:
    """Texts to ids and back, as the file's own library does with no special tokens added."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.coder = TrieCoder(model["vocab"], merges, model["end_of_word_suffix"])
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.symbol = dict(enumerate(byte_symbols()))
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    def chunks(self, text: str) -> list[str]:
        """White-space chunks of a normalized text; special tokens stand alone after a NUL and a blank."""
        out = []
        for part in self.cut.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(" " + part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            low = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            out += low.split() if not re.search("[\x1c-\x1f]", low) else [x for x in re.split(f"[{WHITE}]+", low) if x]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Fill the dictionaries for chunks that they lack."""
        if len(self.ids) > KEPT_CHUNKS:
            self.old, self.ids, self.shown = (self.ids, self.shown), {}, {}
        ids, shown = self.old
        new = []
        for c in chunks:
            if c not in self.ids:
                if c in ids:
                    self.ids[c], self.shown[c] = ids[c], shown[c]
                else:
                    new.append(c)
        inner = {c: ["".join(map(self.symbol.__getitem__, w.encode("utf-8", "replace"))) for w in self.word.findall(c)] for c in new if c[0] != " "}
        tokens = dict(self.coder.encode({w for words in inner.values() for w in words}))
        vocab = self.coder.vocab
        for c in new:
            names = [t for w in inner[c] for t in tokens[w]] if c[0] != " " else [c[1:]]
            ids = [vocab[t] for t in names] if c[0] != " " else [self.special[c[1:]]]
            self.ids[c], self.shown[c] = struct.pack(f"<{len(ids)}I", *ids), " ".join(names)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Little-endian ids and the decoded text of each text."""
        split = [self.chunks(t) for t in texts]
        self.learn({c for cs in split for c in cs})
        for cs in split:
            yield b"".join(map(self.ids.__getitem__, cs)), " ".join(filter(None, map(self.shown.__getitem__, cs)))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def in_batches(texts: Iterable[str | None], size: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about ``size`` characters; a longer one stands alone."""
    out, held = [], 0
    for t in texts:
        out.append(t or "")
        held += len(out[-1])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32) and decoded text of every row."""
    return _map(docs, tokenizer, {"ids": ("binary", lambda ids, shown: ids), "decoded": ("string", lambda ids, shown: shown)})


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text, without moving either out of the worker."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _map(docs, tokenizer, {"ids_sha256": ("string", lambda ids, shown: sha(ids)), "decoded_sha256": ("string", lambda ids, shown: sha(shown.encode()))})


def _map(docs: DataFrame, tokenizer: str, columns: dict) -> DataFrame:
    kinds = {"binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(tokenizer)
        for b in batches:
            rows = [(len(ids) // 4, *(f(ids, shown) for _, f in columns.values())) for texts in in_batches(x.as_py() for x in b["text"]) for ids, shown in coder.encode(texts)]
            n, *rest = zip(*rows) if rows else [()] * (1 + len(columns))
            arrays = [b["doc_id"], pa.array(n, pa.int64()), *(pa.array(x, kinds[k]) for x, (k, _) in zip(rest, columns.values()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", *columns])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, " + ", ".join(f"{c} {k}" for c, (k, _) in columns.items())
    return docs.select("doc_id", "text").mapInArrow(run, schema)
