"""SentencePiece BPE encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character (checked when the model
is read), so no merge can cross the place before a marker. A text is cut there, and at line ends; each distinct chunk
is segmented once per worker into ids, and decoded once from those ids, and a text's ids and decoded
text are its chunks' joined by position. Chunks that a slice of texts has new are merged together: those of one
length are a matrix of symbols, each row of which has its cheapest pair merged at a time. No shuffle; a task holds one Arrow batch and a table of at most
two generations of TABLE_BYTES and the chunks of one slice; a chunk longer than LONG_CHUNK isn't kept.

Defined results: null and empty texts have begin and end ids only and decode to ''; repeated rows are
encoded each; other columns are kept by ``encode`` whatever their names; a column with the name of a result is replaced.
"""

from __future__ import annotations

import functools
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.tables import set_apart

MARK = "▁"
#: Bytes of the chunks kept per worker, twice over: at this size the table becomes the older one and a new one begins.
TABLE_BYTES = 16 << 20
#: Bytes that an entry takes beside its characters and ids.
ENTRY_BYTES = 200
#: Code points up to which a chunk is kept.
LONG_CHUNK = 256
#: Rows, and code points beyond the first row's, whose ids and texts are given back at once.
SLICE, SLICE_CHARS = 500, 1 << 19
#: Chunks of one length, up to LONG_ROW, from which they are merged as a matrix.
ROWS, LONG_ROW = 16, 40
#: Symbols up to which pairs are looked through instead of kept in a heap.
SHORT = 24
NEVER = float("inf")
NO_RANK = (1 << 31) - 1


class ChunkTable:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.plain[i]}
        self.texts = [None if model.is_byte(i) else self.pieces[i].replace(MARK, " ") if self.plain[i] else "" for i in range(n)]
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.cost = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.begin, self.end = model.bos_id(), model.eos_id()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) or len(self.byte_ids) != 256:
            raise ValueError("pieces of this model cross whitespace markers or there is no byte fallback; chunks can't be cut")
        # no piece holds a line end, so a text can be cut at those, too
        lines = "" if any("\n" in p for p in self.ids) else "\n"
        self.chunks = re.compile(f"{MARK}++[^{MARK}{lines}]*+|[^{MARK}{lines}]++|{lines or '(?!)'}")
        # pairs of pieces that make a piece, in order of their key, and the rank of that piece's cost; the last stands for no pair
        n_pieces, ids = len(self.pieces), self.ids
        pairs = sorted((ids[p[:k]] * n_pieces + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_makes = np.array([i for _, i in pairs] + [0], np.int32)
        places = np.unique([model.get_score(i) for i in range(n)], return_inverse=True)[1]
        self.pair_rank = np.r_[n - places[self.pair_makes[:-1]], NO_RANK].astype(np.int32)
        letters = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.letters = np.full(max(letters, default=0) + 2, -1, np.int32)
        self.letters[list(letters)] = list(letters.values())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Chunks whose ids decode to something else than the chunk with spaces for markers, of both generations.
        self.changed: dict[str, str] = {}
        self.older_changed: dict[str, str] = {}
        self.bytes = 0

    def segment(self, chunk: str) -> list[int]:
        symbols = list(chunk)
        cost = self.cost
        if len(symbols) <= SHORT:
            # the cheapest pair of few symbols is found sooner by looking than by a heap
            costs = [cost.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
            while costs and (least := min(costs)) < NEVER:
                i = costs.index(least)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del costs[i]
                if i < len(costs):
                    costs[i] = cost.get(symbols[i] + symbols[i + 1], NEVER)
                if i:
                    costs[i - 1] = cost.get(symbols[i - 1] + symbols[i], NEVER)
        else:
            bpe.merge(symbols, lambda pair: cost.get(pair[0] + pair[1]))
        out = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                out += [i] if i is not None else [self.byte_ids[b] for b in s.encode()]
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table; its last where they make no piece."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def _merged(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of chunks of one length, given as the ids of their letters: every row merges its cheapest pair, the leftmost of equals, until it has none."""
        rows = np.arange(len(symbols))
        pairs = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            width = symbols.shape[1]
            if width == 1:
                yield rows, symbols
                return
            ranks = self.pair_rank[pairs]
            at = ranks.argmin(1)
            go = ranks[np.arange(len(rows)), at] < NO_RANK
            if not go.all():
                yield rows[~go], symbols[~go]
                rows, symbols, pairs, at = rows[go], symbols[go], pairs[go], at[go]
            every = np.arange(len(rows))
            symbols[every, at] = self.pair_makes[pairs[every, at]]
            stays = np.ones(symbols.shape, bool)
            stays[every, at + 1] = False
            symbols = symbols[stays].reshape(len(rows), width - 1)
            stays = np.ones(pairs.shape, bool)
            stays[every, at] = False
            pairs = pairs[stays].reshape(len(rows), width - 2)
            k = np.flatnonzero(at > 0)
            pairs[k, at[k] - 1] = self._pairs(symbols[k, at[k] - 1], symbols[k, at[k]])
            k = np.flatnonzero(at < width - 2)
            pairs[k, at[k]] = self._pairs(symbols[k, at[k]], symbols[k, at[k] + 1])

    def segmented(self, chunks: Iterable[str]) -> Iterator[tuple[str, bytes, bool]]:
        """Each chunk with its ids as bytes, and whether these may decode to something else than the chunk."""
        sized: dict[int, list[str]] = defaultdict(list)
        for chunk in chunks:
            sized[len(chunk)].append(chunk)
        for length, some in sized.items():
            alone = some
            if len(some) >= ROWS and length <= LONG_ROW:
                points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(-1, length)
                letters = self.letters[np.minimum(points, len(self.letters) - 1)]
                pieces = (letters >= 0).all(1)
                alone = [some[k] for k in np.flatnonzero(~pieces).tolist()]
                all_pieces = np.flatnonzero(pieces)
                for rows, ids in self._merged(letters[pieces]):
                    raw, step = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                    for j, k in enumerate(all_pieces[rows].tolist()):
                        yield some[k], raw[j * step : (j + 1) * step], False
            for chunk in alone:
                ids = self.segment(chunk)
                yield chunk, struct.pack(f"<{len(ids)}I", *ids), True

    def decode_ids(self, ids: list[int]) -> str:
        """Text of the ids, markers as spaces, the leading one kept."""
        texts = [self.texts[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            else:
                out += self.texts[i].encode()
        return out.decode(errors="replace")

    def _learn(self, wanted: set[str]) -> None:
        if self.bytes > TABLE_BYTES:  # what is still in use comes back from the older half
            self.older, self.older_changed, self.known, self.changed, self.bytes = self.known, self.changed, {}, {}, 0
        known, older = self.known, self.older
        new = []
        for chunk in wanted - known.keys():
            packed = older.get(chunk)
            if packed is None:
                new.append(chunk)
                continue
            known[chunk] = packed
            self.bytes += ENTRY_BYTES + 4 * len(chunk) + len(packed)
            if chunk in self.older_changed:
                self.changed[chunk] = self.older_changed[chunk]
        for chunk, packed, other in self.segmented(new):
            known[chunk] = packed
            self.bytes += ENTRY_BYTES + 4 * len(chunk) + len(packed)
            if other and (decoded := self.decode_ids(list(struct.unpack(f"<{len(packed) // 4}I", packed)))) != chunk.replace(MARK, " "):
                self.changed[chunk] = decoded

    def code(self, text: str) -> tuple[bytes, str]:
        ids, decoded = self.code_all([text])
        return ids[0], decoded[0]

    def code_all(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Of each text the ids, as little-endian unsigned 32-bit integers with begin and end, and the text they decode to."""
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        cut = [self.chunks.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        wanted = set().union(*cut)
        if not wanted <= self.known.keys():
            self._learn(wanted)
        known, changed = self.known, self.changed
        ids = [begin + b"".join(map(known.__getitem__, chunks)) + end for chunks in cut]
        decoded = ["".join([changed.get(c, c) for c in chunks] if changed else chunks).replace(MARK, " ")[1:] for chunks in cut]
        for chunk in wanted:
            if len(chunk) > LONG_CHUNK:
                self.bytes -= ENTRY_BYTES + 4 * len(chunk) + len(known.pop(chunk))
                changed.pop(chunk, None)
        return ids, decoded


@functools.lru_cache(2)
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of SLICE rows and about SLICE_CHARS code points at most; null is empty."""
    some, chars = [], 0
    for x in texts:
        some.append(x.as_py() or "")
        chars += len(some[-1])
        if len(some) == SLICE or chars >= SLICE_CHARS:
            yield some
            some, chars = [], 0
    if some:
        yield some


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The documents with n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (text of those ids)."""

    @F.arrow_udf("ids binary, decoded string")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = chunk_table(path).code_all
        for texts in batches:
            for some in slices(texts):
                ids, decoded = code(some)
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    apart, kept, text = set_apart(docs, text_col, ("n_tokens", "ids", "decoded"))
    out = apart.withColumn("coded", coded(text))
    return out.select(*kept, (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"), "coded.ids", "coded.decoded")
