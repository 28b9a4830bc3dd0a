"""Texts as ids of a byte-level BPE vocabulary, exact and in linear time."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.runtime import process_cache

# Fixed value: the pre-tokenizer of this family of vocabularies; white space is the Unicode property.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MEMO = 400_000  # remembered pieces or pairs of a worker process; it starts anew beyond that


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """Encoder of one vocabulary.

    A sequence of tokens is the BPE result exactly if each two neighbours are: if no merge that BPE
    would have made earlier crosses their border. So the encoder walks the piece with the longest
    token at each place, found by an Aho-Corasick automaton over bytes mapped to Latin-1; where it
    doesn't fit its left neighbour, it falls back to the token's next shorter prefix, and from a
    place where nothing fits to the place before. A place given up is never tried again, so the
    work is linear.
    """

    def __init__(self, file: bytes):
        import ahocorasick

        model = json.loads(file)["model"]
        stand_in = _byte_alphabet()
        latin = lambda s: "".join(chr(stand_in[c]) for c in s)
        vocab = {}
        for token, i in model["vocab"].items():
            if all(c in stand_in for c in token):
                vocab[latin(token)] = i
        self.text = {i: t for t, i in vocab.items()}
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank of its merge
        self.halves: dict[int, tuple[int, int]] = {}  # token -> the pair it is made of
        self.rank: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = (latin(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = n
            if c not in self.halves:
                self.halves[c], self.rank[c] = (a, b), n
        usable = {t: i for t, i in vocab.items() if len(t) == 1 or i in self.halves}
        self.size = {i: len(t) for t, i in usable.items()}
        self.shorter = {}
        for t, i in usable.items():
            self.shorter[i] = next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), -1)
        self.whole = usable
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE over both tokens' bytes ends with exactly these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            known = self.pairs[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges from the border outwards, latest first: at each moment of BPE the tokens next
        # to the border are some right part of `left` and left part of `right`. Had their merge a
        # rank below those of the merges undone, BPE would have made it before them.
        limit = 1 << 60
        while True:
            n = self.merged.get((left, right))
            if n is not None and n < limit:
                return False
            rl, rr = self.rank.get(left, -1), self.rank.get(right, -1)
            if rl < 0 and rr < 0:
                return True
            if rl > rr:
                limit, left = rl, self.halves[left][1]
            else:
                # of equal merges BPE makes the left one first
                limit, right = rr + 1, self.halves[right][0]

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text of its bytes."""
        if (i := self.whole.get(s)) is not None:
            return [i]
        n = len(s)
        longest = [0] * n
        for end, (size, i) in self.automaton.iter(s):
            longest[end - size + 1] = i  # later ends are longer tokens
        out: list[int] = []
        dead, at, token = bytearray(n + 1), 0, longest[0]
        size, shorter, fits = self.size, self.shorter, self.fits
        while at < n:
            end = at + size[token]
            if not dead[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    def text_ids(self, text: str, pieces) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for p in pieces(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(p) <= 64:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[p] = ids
            out += ids
        return out


def encode(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the whole text of every row as ids, without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text.
    ``vocabulary``: path of a byte-level BPE file (vocabulary and merges), which the driver reads and
    sends to the executors; its size is fixed. Rows are encoded where they are read, without a shuffle.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        file = f.read()
    shared = documents.sparkSession.sparkContext.broadcast(file)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        import regex

        store = process_cache()
        if ("bpe", len(shared.value)) not in store:
            store["bpe", len(shared.value)] = BytePairs(shared.value)
        model, pieces = store["bpe", len(shared.value)], regex.compile(PIECES).findall
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                flat: list[int] = []
                ends = np.zeros(part.num_rows + 1, dtype=np.int32)
                for k, t in enumerate(part.column(1).to_pylist()):
                    if t:
                        flat += model.text_ids(t, pieces)
                    ends[k + 1] = len(flat)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, dtype=np.int32)))
                yield pa.record_batch([part.column(0), ids], names=[key, "ids"])

    return documents.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")
