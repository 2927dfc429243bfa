"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import code_points, slices, small_batches

BLANK = "▁"
# Longer segments are merged one by one with a heap, so that a text without blanks stays cheap.
LONG = 64
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model with byte fallback. ``rank`` orders merges: the best score first."""

    pieces: list[str]
    ids: np.ndarray  # of the pieces that text can match
    rank: np.ndarray  # by id, and NONE at the end, for no id (-1)
    texts: list[bytes]  # what each id decodes to
    byte_ids: np.ndarray  # id of each byte
    single: dict[str, int]  # characters that are pieces
    splits_lines: bool


def load(path: str) -> Vocabulary:
    """The vocabulary of a byte-pair model file with identity normalisation."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    matched, texts = [], []
    byte_ids = np.zeros(256, np.int64)
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            matched.append(i)
            texts.append(piece.replace(BLANK, " ").encode())
    pieces = [model.id_to_piece(i) for i in matched]
    if any(BLANK in piece.lstrip(BLANK) for piece in pieces):
        raise ValueError("pieces that cross words are not supported")
    rank = np.full(size + 1, NONE, np.int32)
    order = np.argsort([-model.get_score(i) for i in matched], kind="stable")
    rank[np.array(matched)[order]] = np.arange(len(matched))
    single = {piece: i for piece, i in zip(pieces, matched) if len(piece) == 1}
    lines = not any("\n" in piece for piece in pieces)
    return Vocabulary(pieces, np.array(matched), rank, texts, byte_ids, single, lines)


# ---- matching -----------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the text sorted by the ``depth`` characters that start there, and those
    characters packed into integers, most significant first. ``text`` holds ranks from 1; 0 stands
    for what follows the end."""
    per_word = 63 // bits
    padded = np.concatenate([text, np.zeros(depth, text.dtype)]).astype(np.int64)
    keys = []
    for start in range(0, depth, per_word):
        key = np.zeros(len(text), np.int64)
        for at in range(start, start + per_word):
            key <<= bits
            if at < depth:
                key |= padded[at : at + len(text)]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    return order, [key[order] for key in keys]


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: the first place not before (or after) each."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        probe = np.minimum(middle, len(keys[0]) - 1)
        less = np.zeros(len(low), bool)
        tied = np.ones(len(low), bool)
        for key, want in zip(keys, wanted, strict=True):
            value = key[probe]
            less |= tied & (value < want)
            tied &= value == want
        go_up = less | (tied if after else False)
        low = np.where(open_ & go_up, middle + 1, low)
        high = np.where(open_ & ~go_up, middle, high)
    return low


def edges(
    text: np.ndarray, alphabet: np.ndarray, vocabulary: Vocabulary
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and id of every occurrence of every piece of two characters or more, sorted
    by start and length. ``text`` holds places in ``alphabet``."""
    bits = max(1, int(len(alphabet) + 1).bit_length())
    points, starts = code_points(vocabulary.pieces)
    place = np.searchsorted(alphabet, points)
    known = alphabet[np.minimum(place, len(alphabet) - 1)] == points
    lengths = np.diff(starts)
    there = np.logical_and.reduceat(known, starts[:-1]) & (lengths > 1)
    if not there.any():
        return (np.zeros(0, np.int64),) * 3
    depth = int(lengths[there].max())
    order, keys = suffix_array(text + 1, depth, bits)
    chosen = np.flatnonzero(there)
    sizes, ids = lengths[chosen], vocabulary.ids[chosen]
    table = np.zeros((len(chosen), depth), np.int64)
    rows = np.repeat(np.arange(len(chosen)), sizes)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table[rows, inside] = place[np.repeat(starts[:-1][chosen], sizes) + inside] + 1
    filled = np.arange(depth)[None, :] < sizes[:, None]
    highest = (1 << bits) - 1
    per_word = 63 // bits
    first, last = [], []
    for start in range(0, depth, per_word):
        low, high = (np.zeros(len(chosen), np.int64) for _ in range(2))
        for at in range(start, start + per_word):
            low <<= bits
            high <<= bits
            if at < depth:
                low |= table[:, at]
                high |= np.where(filled[:, at], table[:, at], highest)
        first.append(low)
        last.append(high)
    begin, end = _bound(keys, first, False), _bound(keys, last, True)
    counts = end - begin
    total = int(counts.sum())
    run = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)
    where, size, piece = order[run], np.repeat(sizes, counts), np.repeat(ids, counts)
    by_place = np.argsort(where * (depth + 1) + size, kind="stable")
    return where[by_place], size[by_place], piece[by_place]


# ---- relaxation ---------------------------------------------------------------------------


def _merge_rounds(
    ids_at: np.ndarray, ranks: np.ndarray, depth: int, starts: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the best pair of neighbouring symbols of every segment, the leftmost of equals, until
    no segment has one. ``ids_at[place * (depth + 1) + length]`` is the piece of an edge, -1 for
    none. Returns segment, start and length of the symbols that are left."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    begin = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    length = np.ones(len(begin), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(owner[:0], begin[:0], length[:0])]
    while len(begin):
        size = length[:-1] + length[1:]
        pair = (owner[:-1] == owner[1:]) & (size <= depth)
        rank = np.full(len(begin), NONE, np.int32)
        at = np.flatnonzero(pair)
        rank[at] = ranks[ids_at[begin[at] * (depth + 1) + size[at]]]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(rank, first)
        runs = np.diff(np.r_[first, len(owner)])
        alive = np.repeat(best < NONE, runs)
        done.append((owner[~alive], begin[~alive], length[~alive]))
        if not alive.any():
            break
        chosen = np.flatnonzero(alive & (rank == np.repeat(best, runs)))
        chosen = chosen[np.r_[True, owner[chosen][1:] != owner[chosen][:-1]]]
        length[chosen] += length[chosen + 1]
        alive[chosen + 1] = False
        owner, begin, length = owner[alive], begin[alive], length[alive]
    owner, begin, length = (np.concatenate(part) for part in zip(*done, strict=True))
    order = np.argsort(begin, kind="stable")
    return owner[order], begin[order], length[order]


def _merge_long(
    ids_at: np.ndarray, ranks: np.ndarray, depth: int, start: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long segment, with a heap of its pairs."""
    after = list(range(1, size + 1))
    before = list(range(-1, size))
    length = [1] * size

    def pair(left: int) -> tuple | None:
        right = after[left]
        if right >= size or length[left] + length[right] > depth:
            return None
        rank = ranks[ids_at[(start + left) * (depth + 1) + length[left] + length[right]]]
        return None if rank == NONE else (int(rank), left, length[left], length[right])

    heap = [found for left in range(size - 1) if (found := pair(left))]
    heapify(heap)
    while heap:
        _, left, first, second = heappop(heap)
        right = after[left]
        if length[left] != first or right >= size or length[right] != second:
            continue
        length[left] += length[right]
        length[right] = 0
        after[left] = after[right]
        if after[left] < size:
            before[after[left]] = left
        for changed in (left, before[left]):
            if changed >= 0 and (found := pair(changed)):
                heappush(heap, found)
    kept = np.flatnonzero(length)
    return kept + start, np.array(length)[kept]


def encode_segments(
    segments: list[str], vocabulary: Vocabulary
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments after each other, and where those of each segment start."""
    points, offsets = code_points(segments)
    if not len(points):
        return np.zeros(0, np.int64), offsets * 0
    alphabet, text = np.unique(points, return_inverse=True)
    text = text.astype(np.int64)
    where, size, piece = edges(text, alphabet, vocabulary)
    depth = int(size.max(initial=1))
    ids_at = np.full(len(text) * (depth + 1) + depth + 1, -1, np.int32)
    ids_at[where * (depth + 1) + size] = piece
    rank = vocabulary.rank
    sizes = np.diff(offsets)
    short = np.flatnonzero(sizes <= LONG)
    _, begin, length = _merge_rounds(ids_at, rank, depth, offsets[:-1][short], sizes[short])
    parts = [(begin, length)]
    for i in np.flatnonzero(sizes > LONG):
        parts.append(_merge_long(ids_at, rank, depth, int(offsets[i]), int(sizes[i])))
    begin, length = (np.concatenate(part) for part in zip(*parts, strict=True))
    order = np.argsort(begin, kind="stable")
    begin, length = begin[order], length[order]
    # Single characters: a piece of their own, or their bytes.
    fallback: list[np.ndarray] = []
    single = np.full(len(alphabet), -1, np.int64)
    for i, point in enumerate(alphabet.tolist()):
        character = chr(point)
        own = vocabulary.single.get(character)
        if own is None:
            raw = np.frombuffer(character.encode("utf-8", "surrogatepass"), np.uint8)
            fallback.append(vocabulary.byte_ids[raw])
            single[i] = -len(fallback)
        else:
            single[i] = own
    one = length == 1
    ids = np.where(one, single[text[begin]], ids_at[begin * (depth + 1) + length])
    widths = np.ones(len(ids), np.int64)
    missing = ids < 0
    if missing.any():
        size_of = np.array([0] + [len(part) for part in fallback])
        widths[missing] = size_of[-ids[missing]]
        out = np.repeat(ids, widths)
        flat = np.concatenate(fallback)
        base = np.r_[0, 0, np.cumsum(size_of[1:])]
        inside = np.arange(len(out)) - np.repeat(np.cumsum(widths) - widths, widths)
        hit = out < 0
        out[hit] = flat[base[-out[hit]] + inside[hit]]
    else:
        out = ids
    ends = np.r_[0, np.cumsum(widths)]
    return out, ends[np.searchsorted(begin, offsets)]


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts after each other, and where those of each text start. The text of a slice
    is indexed once for each different segment: blanks and the word behind them."""
    pattern = f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n" if vocabulary.splits_lines else f"{BLANK}*[^{BLANK}]+|{BLANK}+"
    find = re.compile(pattern).findall
    known: dict[str, int] = {}
    codes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        found = find(BLANK + text.replace(" ", BLANK))
        counts[i] = len(found)
        codes.extend([known.setdefault(segment, len(known)) for segment in found])
    ids, starts = encode_segments(list(known), vocabulary)
    order = np.array(codes, np.int64)
    sizes = np.diff(starts)[order] if len(order) else order
    total = int(sizes.sum())
    places = np.repeat(starts[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    ends = np.r_[0, np.cumsum(sizes)]
    return ids[places], ends[np.r_[0, np.cumsum(counts)]]


def decode_ids(ids: np.ndarray, starts: np.ndarray, texts: pa.Array) -> list[str]:
    """The text of each run of ids, without the blank that encoding puts in front; bytes that are
    not UTF-8 become replacement characters."""
    taken = texts.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :]
    data = taken.buffers()[2]
    raw = memoryview(data) if data is not None else memoryview(b"")
    out = []
    for a, b in zip(offsets[starts[:-1]].tolist(), offsets[starts[1:]].tolist()):
        text = bytes(raw[a:b]).decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


# ---- Spark --------------------------------------------------------------------------------


def encode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row, as the library's own encoder gives them.

    The model file is read once, on the driver. Texts are processed whole, in slices of bounded
    bytes. Null and empty texts have no ids; null keys and repeated rows are kept; other columns
    are not read. Only blanks are rewritten, so decoding gives the text back, but for a text that
    has the mark for blanks (U+2581) itself: as with the library, it comes back with blanks.
    """
    vocabulary = load(path)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            ids, starts = encode_texts(part.column(1).to_pylist(), vocabulary)
            lists = pa.ListArray.from_arrays(
                pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(starts)), lists],
                names=["doc_id", "n_tokens", "ids"],
            )

    return small_batches(rows).mapInArrow(
        run, f"doc_id {key_type}, n_tokens bigint, ids array<int>"
    )


def encode_and_decode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``encode`` with the text decoded from the ids, and whether it equals the given one."""
    vocabulary = load(path)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.texts, pa.large_binary())
        for part in slices(batches, 1):
            texts = part.column(1).to_pylist()
            ids, starts = encode_texts(texts, vocabulary)
            lists = pa.ListArray.from_arrays(
                pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))
            )
            decoded = decode_ids(ids, starts, known)
            same = [made == (given or "") for made, given in zip(decoded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(starts)), lists,
                 pa.array(decoded, pa.string()), pa.array(same)],
                names=["doc_id", "n_tokens", "ids", "decoded", "round_trip"],
            )

    return small_batches(rows).mapInArrow(
        run,
        f"doc_id {key_type}, n_tokens bigint, ids array<int>, decoded string, round_trip boolean",
    )


def decode(
    encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """``doc_id, text`` of every row; null ids give an empty text."""
    texts = load(path).texts
    rows = encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(texts, pa.large_binary())
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                found = decode_ids(lists.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)], known)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.string())], names=["doc_id", "text"]
                )

    return small_batches(rows).mapInArrow(run, f"doc_id {key_type}, text string")
