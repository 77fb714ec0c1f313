"""BPE encoding and decoding by a trie over the distinct words of a batch of texts."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeloom.llm.base import append, byte_letters, pieces, vocabulary

#: Words a worker keeps encoded between batches; words beyond are encoded anew in each batch.
KEPT_WORDS = 300_000
#: White space and letters of Latin texts, where the standard pattern module and the tokenizer agree.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
LATIN = "a-zªµºß-öø-ɏ"
WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LATIN}]+|[0-9²³¹¼-¾]|[^\s{LATIN}0-9²³¹¼-¾]+")

_coders: dict[str, "TrieCoder"] = {}


class TrieCoder:
    """Encoder for one tokenizer file of the kind "byte-level letters, word-end suffix, ranked merges"."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = vocabulary(path)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.text_of = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.parts = {self.vocab[a + b]: (self.vocab[a], self.vocab[b], k) for k, (a, b) in reversed([*enumerate(merges)])}
        self.number = {i: i.to_bytes(4, "little") for i in self.text_of}
        self.tokens = self.token_trie()
        self.letters = byte_letters()
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.joined: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, tuple[bytes, str]] = {}

    def token_trie(self) -> dict:
        """The vocabulary as nested dictionaries of letters; a token's id stands under "" or the word-end mark."""
        root: dict = {}
        for token, i in self.vocab.items():
            body = token.removesuffix(self.suffix) if self.suffix else token
            node = root
            for letter in body:
                node = node.setdefault(letter, {})
            node[self.suffix if len(body) < len(token) else ""] = i
        return root

    def words(self, text: str) -> list[str]:
        """Words of a stretch without special tokens, as the tokenizer splits it."""
        if PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        norm = self.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(norm)]

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave two tokens side by side. Their last merges are undone, latest first; the tokens
        then at the border would have merged if their rank came before what was just undone (at equal rank the left
        pair merges first)."""
        a, b, before = left, right, 1 << 30
        while True:
            if self.rank.get((a, b), before) < before:
                apart = False
                break
            of_a, of_b = self.parts.get(a), self.parts.get(b)
            if of_a is None and of_b is None:
                apart = True
                break
            if of_b is None or (of_a is not None and of_a[2] > of_b[2]):
                a, before = of_a[1], of_a[2]
            else:
                b, before = of_b[0], of_b[2] + 1
        if len(self.joined) > 2_000_000:
            self.joined.clear()
        self.joined[left, right] = apart
        return apart

    def encode_words(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """Ids (little-endian 32 bits) and token texts of distinct words. The words go into a trie of letters; one
        depth-first walk gives every node the last token of its prefix, so a shared prefix is encoded once."""
        trie: dict = {}
        letters, number, said = self.letters, self.number, self.text_of
        for word in words:
            node = trie
            spelled = word if word.isascii() and word.isprintable() else "".join(map(letters.__getitem__, word.encode()))
            for letter in spelled:
                below = node.get(letter)
                if below is None:
                    below = node[letter] = {}
                node = below
            node[""] = (word, spelled)
        out: dict[str, tuple[bytes, str]] = {}
        joined, stays, tokens, suffix = self.joined, self.stays, self.tokens, self.suffix or ""
        states: list[tuple[int, int]] = [(-1, 0)]  # by length of the prefix: its last token and that token's length
        begun: list[list] = [[]]  # by length of the prefix: where tokens may have begun, and how far they have come
        todo = [(0, "", trie)]
        while todo:
            depth, letter, node = todo.pop()
            ends = node.get("")
            if depth:
                del states[depth:], begun[depth:]
                live = [(at, far) for at, t in begun[depth - 1] if (far := t.get(letter)) is not None]
                if (far := tokens.get(letter)) is not None:
                    live.append((depth - 1, far))
                begun.append(live)
                state = (-1, 0)
                if len(node) > (ends is not None):  # some word goes on from here
                    for at, t in live:  # longest first; the one that stays apart from the token before it is right
                        token = t.get("")
                        if token is not None and (at == 0 or (
                                known if (known := joined.get((states[at][0], token))) is not None else stays(states[at][0], token))):
                            state = (token, depth - at)
                            break
                states.append(state)
            if ends is not None:
                ids, at = [], depth
                for start, t in begun[depth]:
                    token = t.get(suffix)
                    if token is not None and (start == 0 or (
                            known if (known := joined.get((states[start][0], token))) is not None else stays(states[start][0], token))):
                        ids, at = [token], start
                        break
                while at > 0:
                    token, k = states[at]
                    ids.append(token)
                    at -= k
                ids.reverse()
                out[ends[0]] = (b"".join([number[i] for i in ids]), " ".join([said[i] for i in ids]))
            for letter, child in node.items():
                if letter:
                    todo.append((depth + 1, letter, child))
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of every text."""
        split = []
        for text in texts:
            runs = self.at_special.split(text) if self.at_special and "<|" in text else [text]
            split.append([(run in self.special, [run] if run in self.special else self.words(run)) for run in runs])
        kept = self.kept
        new = {w for runs in split for special, ws in runs if not special for w in ws if w not in kept}
        coded = self.encode_words(new)
        if len(kept) + len(coded) <= KEPT_WORDS:
            kept.update(coded)
            coded = kept
        elif coded:
            coded = kept | coded if len(coded) < 50_000 else _Either(coded, kept)
        else:
            coded = kept
        coded_special = {t: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}
        out = []
        for runs in split:
            ids, said = [], []
            for special, ws in runs:
                found = [*map((coded_special if special else coded).__getitem__, ws)]
                ids += [x for x, _ in found]
                said += [x for _, x in found]
            out.append((b"".join(ids), " ".join(said)))
        return out


class _Either(dict):
    """A dictionary that falls back on a second one."""

    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key):
        return self.second[key]


def coder(path: str) -> TrieCoder:
    """The worker's encoder for a file; tasks that run in the same worker share its kept words."""
    if path not in _coders:
        _coders[path] = TrieCoder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of long) and ``decoded`` (token texts joined by blanks, as a tokenizer file
    without decoder says). A null text counts as empty and gives no ids and an empty text. Rows are independent, so
    repeated rows, null ids and other columns pass through; existing columns of those two names are replaced."""
    docs = docs.drop("ids", "decoded")

    def make(batch):
        coded = coder(path).encode_batch(pc.fill_null(batch.column(text), "").to_pylist())
        return [pa.array([memoryview(i).cast("I").tolist() for i, _ in coded], pa.list_(pa.int64())),
                pa.array([t for _, t in coded], pa.string())]

    return append(docs, text, [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())], make)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; the digests are taken where the ids are made."""

    def run(batches):
        for batch in pieces(batches, "text"):
            coded = coder(path).encode_batch(pc.fill_null(batch.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in coded])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
