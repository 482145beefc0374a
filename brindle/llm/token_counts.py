"""Token counts at every prefix, by dynamic programming over the word vocabulary's compatible last tokens.

For each position in a word the encoding of the prefix up to it is unique, so its last token is too: the one token
that ends there, starts where another prefix ends, and is compatible with that prefix's last token. One pass stores
the count at every prefix, both as an unfinished word (more letters follow) and as a finished one (with the end
mark). A text's counts are running sums over its words, so the count of any prefix, and the longest prefix within
a budget, come from the stored tables and never from encoding again.

Text handling is that of the vocabulary file: special strings are cut out first and count one token; the rest
is composed (NFC), white space separates, letters are lower-cased, and words are split at contractions, runs of
letters, single digits and runs of other signs.

Defined cases: a null text counts as empty; texts are taken whole, whatever their length; rows are independent.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import Merges, Seen, byte_letters
from .shared import load

LIMIT = 2048
#: Entries of a worker's memory of counted chunks.
MEMORY = 250_000


class WordBPE:
    """A vocabulary whose words end in a mark (``</w>``)."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, model = byte_letters(), data["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        join = lambda a, b: vocab[a + b]
        self.merges = Merges({(vocab[a], vocab[b]): (rank, join(a, b)) for rank, (a, b) in enumerate(pairs)})
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, i in vocab.items():
            if t.endswith(end) and t != end:
                self.final[raw(t.removesuffix(end))] = i
            else:
                self.inner[raw(t)] = i
        inner_leaf, final_leaf = dict(self.inner), dict(self.final)
        leaf = lambda t, last: [*(inner_leaf[t[k : k + 1]] for k in range(len(t) - 1)), (final_leaf if last else inner_leaf)[t[-1:]]]
        # Tokens that merging their own letters doesn't give can't be in an encoding.
        self.inner = {t: i for t, i in self.inner.items() if self.merges.merge(leaf(t, False)) == [i]}
        self.final = {t: i for t, i in self.final.items() if self.merges.merge(leaf(t, True)) == [i]}
        self.longest: dict[bytes, int] = {}
        for t in [*self.inner, *self.final]:
            for k in (1, 2):
                if len(t) >= k:
                    self.longest[t[-k:]] = max(self.longest.get(t[-k:], 0), len(t))
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.memory: dict[str, int] = {}
        self._words: dict[bytes, int] = {}
        self.seen, self._seen_words = Seen(), Seen()

    def table(self, word: bytes, finished: str = "every") -> tuple[list[int], list[int]]:
        """Token counts of every prefix of a word, 0 to its length: unfinished, finished.

        finished="last" fills the finished counts only for the whole word.
        """
        n = len(word)
        last, opened, closed = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        inner, final, longest, fits = self.inner, self.final, self.longest, self.merges.compatible
        for i in range(1, n + 1):
            top = min(longest.get(word[i - 2 : i] if i > 1 else word[:1], 1), i)
            for tokens, ends in ((inner, False), (final, True)):
                if ends and finished == "last" and i < n or not ends and i == n and finished == "last":
                    continue
                for k in range(top, 0, -1):
                    t = tokens.get(word[i - k : i])
                    if t is not None and (k == i or last[i - k] >= 0 and fits(last[i - k], t)):
                        if ends:
                            closed[i] = opened[i - k] + 1
                        else:
                            last[i], opened[i] = t, opened[i - k] + 1
                        break
        return opened, closed

    def word_count(self, word: bytes) -> int:
        found = self._words.get(word)
        if found is None:
            found = self.table(word, "last")[1][-1]
            if self._seen_words.before(word):
                if len(self._words) > MEMORY:
                    self._words.clear()
                self._words[word] = found
        return found

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """(part, whether it is a special string)."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    @staticmethod
    def normal(text: str) -> str:
        """Composed, lower case letter by letter (a sigma that ends a word stays a plain one)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[bytes]:
        if text.isascii() and text.isalpha():  # the usual case without the pattern
            return [text.lower().encode()]
        return [w.encode() for w in self.WORDS.findall(self.normal(text))]

    def chunk_count(self, chunk: str) -> int:
        found = self.memory.get(chunk)
        if found is None:
            found = sum(map(self.word_count, self.words(chunk)))
            if self.seen.before(chunk):
                if len(self.memory) > MEMORY:
                    self.memory.clear()
                self.memory[chunk] = found
        return found

    def count(self, text: str) -> int:
        count = self.chunk_count
        return sum(1 if special else sum(map(count, part.replace("\n", " ").split(" "))) for part, special in self.segments(text))

    def prefix_counts(self, text: str) -> list[tuple[int, int]]:
        """(end, tokens) in the normalised text: the exact count of the prefix that ends at each word's letter.

        The prefix is counted as a text of its own, so the word it cuts is a finished one. Positions are in
        characters; between entries the count stays.
        """
        out, base, done = [(0, 0)], 0, 0
        for part, special in self.segments(text):
            if special:
                base += 1
                done += len(part)
                out.append((done, base))
                continue
            part = self.normal(part)
            for m in self.WORDS.finditer(part):
                word = m.group()
                _, closed = self.table(word.encode())
                at = 0
                for k, c in enumerate(word, start=1):
                    at += len(c.encode())
                    out.append((done + m.start() + k, base + closed[at]))
                base += closed[-1]
            done += len(part)
        return out

    def fit(self, text: str, budget: int) -> str:
        """The longest run of whole words, from the start of the normalised text, of at most ``budget`` tokens."""
        base, out = 0, ""
        for part, special in self.segments(text):
            if special:
                base += 1
                if base > budget:
                    return out
                out += part
                continue
            part, at = self.normal(part), 0
            for m in self.WORDS.finditer(part):
                base += self.word_count(m.group().encode())
                if base > budget:
                    return out + part[:at]
                at = m.end()
            out += part
        return out


_OPEN: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    if path not in _OPEN:
        _OPEN[path] = WordBPE(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _mapped(docs: DataFrame, text_column: str, extra: str, rows, path: str | None) -> DataFrame:
    path = path or default_path()
    docs = docs.drop(*[e.split()[0] for e in extra.split(", ")])  # what has these names already is replaced
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for piece in K.pieces(batch, text_column):
                found = rows(bpe, [x or "" for x in piece.column(text_column).to_pylist()])
                yield pa.RecordBatch.from_arrays([*piece.columns, *found], names=[*piece.schema.names, *[e.split()[0] for e in extra.split(", ")]])

    return docs.mapInArrow(run, ", ".join([*kinds, extra]))


def prefix_tables(docs: DataFrame, path: str | None = None, text_column: str = "text") -> DataFrame:
    """All columns, and prefix_ends, prefix_tokens: the exact token count at every prefix of the normalised text."""

    def rows(bpe, texts):
        tables = [bpe.prefix_counts(t) for t in texts]
        return [pa.array([[p[k] for p in t] for t in tables], pa.list_(pa.int32())) for k in (0, 1)]

    return _mapped(docs, text_column, "prefix_ends array<int>, prefix_tokens array<int>", rows, path)


def within(tables: DataFrame, budget: int) -> DataFrame:
    """All columns, and end_within: the longest prefix of at most ``budget`` tokens, from the stored tables alone."""
    fits = F.filter(F.arrays_zip("prefix_ends", "prefix_tokens"), lambda p: p["prefix_tokens"] <= budget)
    return tables.withColumn("end_within", F.array_max(F.transform(fits, lambda p: p["prefix_ends"])))


def truncated(docs: DataFrame, budget: int, path: str | None = None, text_column: str = "text") -> DataFrame:
    """All columns, and text_within: whole words of the normalised text up to ``budget`` tokens."""
    return _mapped(docs, text_column, "text_within string", lambda bpe, texts: [pa.array([bpe.fit(t, budget) for t in texts], pa.string())], path)


def counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    path = path or default_path()
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for piece in K.pieces(batch):
                texts = piece.column("text").to_pylist()
                n = np.array([bpe.count(t) for t in texts], dtype=np.int64)
                size = np.array([len(t.encode()) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(load(spark, sf_dir, "documents"))
