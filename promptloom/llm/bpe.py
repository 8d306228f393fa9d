"""Byte-level BPE encoding and decoding with batched merge rounds in numpy.

A text is cut into pre-tokens. The distinct pre-tokens that a worker has not met before are merged together: the symbols of all of them lie in one flat array, the
rank of each adjacent pair is found by binary search over the sorted pair keys of the merge table, and a round merges the lowest pairs of every word at once.
Ids of a text are then gathered from the merged words. Decoding gathers the bytes of each id.

A pair is merged in the round in which no lower pair lies within ``block`` symbols of it on either side, where ``block`` is the length of the longest token. A
lower pair farther away could only reach it by a token longer than any, so long words take part with many places a round, and results equal those of merging one
lowest pair after the other. Overlapping equal pairs go from the left; such a run waits until it may be merged as a whole. This needs merges in trained order (a merge comes after
those that make its parts), which is checked when the table is read.

Pre-tokens come from the tokenizer's pattern; texts with characters whose class may differ between Unicode versions are cut by the tokenizer's own
pre-tokenizer. Strings of added tokens become their ids first, as the tokenizer does by default.

Defined cases: a null or empty text has no ids; a text of any length is encoded whole; repeated rows and ids are handled one by one; an empty table gives no rows;
further columns are ignored unless named in ``keep``. Decoding turns null into an empty text, skips null and unknown ids, and replaces bytes that are not UTF-8
by U+FFFD.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptloom.llm.spans import emit, slices
from promptloom.llm.tokens import _SETTLED as SETTLED, PATTERN

#: A worker forgets its merged words when they are more than this many or hold more than this many bytes.
CACHE_WORDS = 300_000
CACHE_BYTES = 16 << 20
_NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def read_table(path: str) -> dict:
    """Vocabulary and merges of a tokenizer file as plain values: what a worker needs, without the file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that depend on their surroundings")
    vocabulary, letters = model["vocab"], byte_letters()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max([*vocabulary.values(), *added.values()])
    strings = {i: s for s, i in [*vocabulary.items(), *added.items()]}
    tokens = [_token_bytes(strings.get(i, ""), letters) for i in range(size)]
    first = np.full(256, -1, np.int64)
    for letter, byte in letters.items():
        first[byte] = vocabulary.get(letter, -1)
    if (first < 0).any():
        raise ValueError(f"{path} lacks single bytes")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    sides = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    made = np.full(size, -1, np.int64)
    ranks = np.arange(len(sides))
    made[sides[:, 2]] = ranks  # the last merge that makes a token
    if (np.maximum(made[sides[:, 0]], made[sides[:, 1]]) >= ranks).any():
        raise ValueError(f"{path} has merges before those that make their parts")
    keys = sides[:, 0] * size + sides[:, 1]
    order = np.argsort(keys)
    return {"size": size, "added": added, "special": [t["id"] for t in spec["added_tokens"] if t["special"]], "body": b"".join(tokens),
            "starts": np.cumsum([0, *map(len, tokens)]), "first": first, "keys": keys[order], "ranks": order.astype(np.int64), "result": sides[:, 2].copy(),
            "block": max(len(tokens[i]) for i in vocabulary.values())}


class Table:
    """A merge table made of the values of ``read_table``."""

    def __init__(self, values: dict):
        self.__dict__.update(values)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where there is no merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE) if len(self.keys) else np.full(len(wanted), _NONE)


def _token_bytes(token: str, letters: dict[str, int]) -> bytes:
    """Bytes of a vocabulary entry; an added token with other characters stands for itself."""
    return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()


def merge_words(table: Table, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words behind each other, and the bounds of each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    symbols = table.first[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    ranks = np.full(len(symbols), _NONE)
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    ranks[inside] = table.rank(symbols[inside], symbols[inside + 1])
    done = []
    while len(symbols):
        # Words without a pair to merge leave the array.
        firsts = np.flatnonzero(np.diff(owner, prepend=-1))
        sizes = np.diff(firsts, append=len(owner))
        open_ = np.repeat(np.minimum.reduceat(ranks, firsts) < _NONE, sizes)
        done.append((owner[~open_], symbols[~open_]))
        symbols, owner, ranks = symbols[open_], owner[open_], ranks[open_]
        if not len(symbols):
            break
        merged = _lowest(ranks, owner, table.block)
        at = np.flatnonzero(merged)
        symbols[at] = table.result[ranks[at]]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        # Pairs that changed: those of merged symbols and those right in front of them.
        stale = merged.copy()
        stale[at[at > 0] - 1] = True
        symbols, owner, ranks, stale = symbols[kept], owner[kept], ranks[kept], stale[kept]
        ranks[stale] = _NONE
        todo = np.flatnonzero(stale)
        todo = todo[todo + 1 < len(owner)]
        todo = todo[owner[todo] == owner[todo + 1]]
        ranks[todo] = table.rank(symbols[todo], symbols[todo + 1])
    owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
    symbols = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return symbols[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1))


def _lowest(ranks: np.ndarray, owner: np.ndarray, block: int) -> np.ndarray:
    """Places of the pairs to merge now."""
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(firsts, append=len(owner))
    place = np.arange(len(owner)) - np.repeat(firsts, sizes)
    starts = np.flatnonzero(place % block == 0)
    low = np.minimum.reduceat(ranks, starts)
    near = low.copy()
    same = owner[starts[1:]] == owner[starts[:-1]]
    near[1:][same] = np.minimum(near[1:][same], low[:-1][same])
    near[:-1][same] = np.minimum(near[:-1][same], low[1:][same])
    chosen = (ranks == np.repeat(near, np.diff(starts, append=len(owner)))) & (ranks < _NONE)
    # Runs of overlapping equal pairs: every second one from the left, and only where the whole run is chosen.
    linked = np.zeros(len(ranks), bool)
    linked[1:] = (ranks[1:] == ranks[:-1]) & (ranks[1:] < _NONE) & (owner[1:] == owner[:-1])
    heads = np.flatnonzero(~linked)
    lengths = np.diff(heads, append=len(ranks))
    whole = np.repeat(np.logical_and.reduceat(chosen, heads), lengths)
    return whole & ((np.arange(len(ranks)) - np.repeat(heads, lengths)) % 2 == 0)


class Words:
    """Merged words of a worker: ids of word ``k`` are ``ids[bounds[k]:bounds[k + 1]]``."""

    def __init__(self, table: Table):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.waiting: list[str] = []
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def number(self, piece: str) -> int:
        at = self.index.get(piece)
        if at is None:
            at = self.index[piece] = len(self.index)
            self.waiting.append(piece)
        return at

    def settle(self) -> None:
        """Merge all words met since the last call."""
        if self.waiting:
            ids, bounds = merge_words(self.table, [w.encode() for w in self.waiting])
            self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.waiting = []

    def full(self) -> bool:
        return len(self.index) > CACHE_WORDS or self.ids.nbytes > CACHE_BYTES


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` behind each other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _cutter(table: Table):
    """A function from a text to its pre-tokens, in which an added token is its id."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    own = ByteLevel(add_prefix_space=False)
    find, settled = regex.compile(PATTERN).findall, regex.compile(SETTLED).fullmatch
    added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(table.added, key=len, reverse=True)) + ")") if table.added else None

    def pieces(text: str) -> list[str]:
        if text.isascii() or settled(text):
            return find(text)
        return [text[low:high] for _, (low, high) in own.pre_tokenize_str(text)]

    def cut(text: str) -> list:
        if added is None or not added.search(text):
            return pieces(text)
        return [p for k, part in enumerate(added.split(text)) if part for p in ([table.added[part]] if k % 2 else pieces(part))]

    return cut


def _fields(df: DataFrame, keep: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return "".join(f"`{c}` {kinds[c]}, " for c in keep)


def _decoder(table: Table, skip_special_tokens: bool = False):
    """A function from ids and the bounds of their lists to texts."""
    starts, body = table.starts, np.frombuffer(table.body, np.uint8)
    sizes = np.append(np.diff(starts), 0)  # an unknown id has no bytes
    if skip_special_tokens:
        sizes[table.special] = 0

    def texts(ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        ids = np.where((ids < 0) | (ids >= table.size), table.size, ids)
        lengths = sizes[ids]
        data = gather(body, starts[ids], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]

    return texts


def _encoder(table: Table):
    """A function from the texts of a slice to their ids behind each other and the bounds of each text."""
    cut, words = _cutter(table), Words(table)

    def ids_of(texts) -> tuple[np.ndarray, np.ndarray]:
        # Added tokens are numbered below zero.
        numbers, rows = [], np.zeros(texts.rows + 1, np.int64)
        for row in range(texts.rows):
            numbers += [words.number(p) if p.__class__ is str else -1 - p for p in cut(texts.bytes_of(row).decode())]
            rows[row + 1] = len(numbers)
        words.settle()
        number = np.array(numbers, np.int64)
        lone, at = number < 0, np.maximum(number, 0)
        bounds = words.bounds if len(words.bounds) > 1 else np.zeros(2, np.int64)
        lengths = np.where(lone, 1, bounds[at + 1] - bounds[at])
        # Added ids stand behind the words' ids.
        ids = gather(np.concatenate([words.ids, np.arange(table.size, dtype=np.int32)]), np.where(lone, len(words.ids) - 1 - number, bounds[at]), lengths)
        if words.full():
            words.clear()
        return ids, np.concatenate([[0], np.cumsum(lengths)])[rows]

    return ids_of


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The named columns and ``ids``, the token ids of every whole text; with ``decoded`` also the text that these ids decode to."""
    keep = keep or ["doc_id"]
    # As large as the vocabulary.
    shared = docs.sparkSession.sparkContext.broadcast(read_table(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        ids_of, texts_of_ids = _encoder(table), _decoder(table)
        for batch, texts in slices(batches):
            ids, bounds = ids_of(texts)
            more = {"decoded": pa.array(texts_of_ids(ids, bounds), pa.string())} if decoded else {}
            yield emit(batch, keep, ids=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), **more)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, _fields(docs, keep) + "ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, tokenizer_path: str, keep: list[str] | None = None, skip_special_tokens: bool = False) -> DataFrame:
    """The named columns and ``text``, the decoded ``ids``."""
    keep = keep or ["doc_id"]
    values = read_table(tokenizer_path)
    shared = encoded.sparkSession.sparkContext.broadcast({k: values[k] for k in ("size", "special", "starts", "body")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of_ids = _decoder(Table(shared.value), skip_special_tokens)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                lists = batch.column(batch.schema.get_field_index("ids"))
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                yield emit(batch, keep, text=pa.array(texts_of_ids(ids, np.concatenate([[0], np.cumsum(counts)])), pa.string()))

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, _fields(encoded, keep) + "text string")
